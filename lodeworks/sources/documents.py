"""JSON entities, whole-text pages and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.tables import SCHEMAS


def read_entity(spark: SparkSession, path: str, entity: str, multi_line: bool = True) -> DataFrame:
    """JSON documents of an entity by its declared schema; a document that doesn't fit fails the read."""
    return spark.read.schema(SCHEMAS[entity]).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def read_folder(spark: SparkSession, path: str, schema: str | None = None, faulty: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(documents with _file, faults) of the JSON files below a folder, one document each; faults: (file, text) of those that are none.

    schema: DDL; without one it is the union of what the files have. faulty: "fail" raises at once if there is a fault,
    "route" gives both tables, "empty" gives no documents at all if there is one, as a listing that must be whole does.
    """
    if faulty not in ("fail", "route", "empty"):
        raise ValueError(f"no such policy: {faulty}")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_text"))
    whole = F.try_parse_json("_text")
    good = F.schema_of_variant(whole).startswith("OBJECT")
    bad = raw.filter(~F.coalesce(good, F.lit(False))).select(F.col("_file").alias("file"), F.col("_text").alias("text"))
    fine = raw.filter(F.coalesce(good, F.lit(False)))
    if schema is None:
        found = fine.agg(F.schema_of_variant_agg(whole)).first()[0]
        if found is None or found == "VOID":
            return fine.select("_file"), bad
        schema = found.removeprefix("OBJECT<").removesuffix(">").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
        docs = fine.select(F.from_json("_text", f"STRUCT<{schema}>").alias("_d"), "_file").select("_d.*", "_file")
    else:
        docs = fine.select(F.from_json("_text", schema).alias("_d"), "_file").select("_d.*", "_file")
    if faulty != "route" and not bad.isEmpty():
        if faulty == "fail":
            raise ValueError(f"not a JSON document: {bad.first().file}")
        docs = docs.limit(0)
    return docs, bad


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return read_entity(spark, path, "history", multi_line=False)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): each text file of a folder as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def best_capture(attempts: DataFrame, key: list[str], good: Column, priority: str) -> DataFrame:
    """Of several captures of a page the first good one by priority, else the first."""
    w = W.partitionBy(*key).orderBy(F.when(good, 0).otherwise(1), priority)
    return attempts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def json_value(json: Column, path: str, kind: str) -> Column:
    """A value of a JSON text by path, null where it is absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def json_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): every scalar within JSON texts, however deep, as text, with the path of names and places to it.

    One level is unfolded at a time, until no object or array is left; texts that aren't JSON have none. A
    string that is JSON itself is unfolded like the rest; nulls are left out.
    """
    from lodeworks.sources.snapshots import cut

    now = df.select(key, F.lit("$").alias("path"), F.col(json).alias("_j")).filter(F.try_parse_json("_j").isNotNull())
    out, fields, items = None, "map<string,string>", "array<string>"
    while True:
        kind = F.substring(F.ltrim("_j"), 1, 1)
        inner = F.when(kind == "{", F.map_entries(F.from_json("_j", fields))).when(kind == "[", F.transform(F.from_json("_j", items), lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("key"), x.alias("value"))))
        step = F.when(kind == "{", F.concat(F.lit("."), F.col("_c.key"))).otherwise(F.col("_c.key"))
        rows = now.select(key, "path", "_j", F.explode(inner).alias("_c")).select(key, F.concat("path", step).alias("path"), F.col("_c.value").alias("_j")).filter("_j is not null")
        rows = cut(rows)
        nested = F.substring(F.ltrim("_j"), 1, 1).isin("{", "[") & F.try_parse_json("_j").isNotNull()
        leaf = rows.filter(~nested).select(key, "path", F.col("_j").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        now = rows.filter(nested)
        if now.isEmpty():
            return out


def json_references(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, target): the values within JSON texts that point to files: relative paths and names with an extension."""
    return json_leaves(df, key, json).filter(F.col("value").rlike(r"^\.{1,2}/|^[\w@.-]+(/[\w@.*-]+)+$")).select(key, "path", F.col("value").alias("target"))


def string_record(json: Column) -> Column:
    """An object's string values by name; null for what isn't an object."""
    kept = F.map_filter(F.from_json(json, "map<string,string>"), lambda _, v: v.isNotNull() & ~F.trim(v).rlike(r"^([\[{].*|-?\d+(\.\d+)?|true|false)$"))
    return F.when(F.ltrim(json).startswith("{"), kept)


def configured(own: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """own with column taken from the side files where a row has none of its own."""
    other = side.select(key, F.col(column).alias("_side"))
    return own.join(other, key, "left").withColumn(column, F.coalesce(column, "_side")).drop("_side")
