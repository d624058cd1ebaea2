"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; rank r of a source with n rows gets the fractional
rank (2r + 1) / 2n. In the order of fractional ranks every stretch has each source in its share of the whole, so
cutting that order into equal runs makes shards that all match the mixture; their row counts differ by one at most.

Both rankings are exact and spread out: rows are dealt into ranges of the ordering key that hold a bounded number of
rows, ranked there by a window, and shifted by the counts of earlier ranges. No source, however large, meets in a task.

Cases: a null text has no bytes; a null source is a source of its own; ties in the hash fall to the id; of repeated
rows the order among equals is arbitrary but each gets its own slot; an empty table gives no rows; more shards than
rows leaves shards empty; other columns are ignored. Equal texts are not held together: the law is on row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint, spread

#: The range of the 32-bit prefix of the shuffling hash.
_SPAN = 1 << 32


def ranked(df: DataFrame, within: list[str], part: Column, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Add name, the 0-based rank by order within the columns of within; part (increasing with order) names the range a row is in.

    The counts of earlier ranges are read from files, so that Spark sends them to all tasks while they are small.
    """
    df = df.withColumn("_part", part)
    counts = df.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*within).orderBy("_part")) - F.col("_n")).drop("_n")
    before = scratch.keep(before, f"before{name}")
    first = F.row_number().over(W.partitionBy(*within, "_part").orderBy(*order)) - 1
    own = df.withColumn("_row", first)
    same = [own[c].eqNullSafe(before[c]) for c in [*within, "_part"]]
    return own.join(before, same).select(*[own[c] for c in df.columns if c != "_part"], (F.col("_before") + own["_row"]).alias(name))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 20, id_col: str = "doc_id", source_col: str = "source", carry: dict[str, Column] | None = None, per_part: int = 50_000) -> DataFrame:
    """docs' rows as (doc_id, source, the columns of carry, shard, slot, fraction). per_part: rows that one range holds on average."""
    more = carry or {}
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("_key"), *(c.alias(n) for n, c in more.items())), "keys")
        sizes = rows.groupBy("source").agg(F.count("*").alias("_of"))
        sizes = scratch.keep(sizes, "sizes")
        total = sizes.agg(F.coalesce(F.sum("_of"), F.lit(0))).first()[0]
        ranges = spread(total, per_part, 64)
        prefix = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
        own = ranked(rows, ["source"], F.floor(prefix * ranges / _SPAN), ["_key", "doc_id"], "_rank", scratch)
        big = sizes.withColumnRenamed("source", "_source")
        fraction = (2 * F.col("_rank") + 1) / (2 * F.col("_of"))
        own = scratch.keep(own.join(big, own["source"].eqNullSafe(big["_source"])).select("doc_id", "source", "_key", *more, fraction.alias("fraction")), "fractions")
        whole = ranked(own.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("fraction") * ranges), ["fraction", "source", "_key", "doc_id"], "_at", scratch)
        # Shard s has the places from ceil(s * total / shards) on.
        shard = F.floor(F.col("_at") * shards / F.lit(max(total, 1)))
        start = F.ceil(shard * F.lit(total) / shards)
        out = whole.select("doc_id", "source", *more, shard.cast("int").alias("shard"), (F.col("_at") - start).cast("long").alias("slot"), "fraction")
        return checkpoint(out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most and whose mixtures of sources agree."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sizes = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)}
    placed = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=sizes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: The CRC-32 of each text byte by byte, and ranks by sorting.
OP7_SQL = """
WITH table_of AS (
    SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(n))
), hashed AS (
    SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(concat_ws(':', '20', CAST(doc_id AS VARCHAR))) AS key,
           xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(crcs[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS text_crc32
    FROM documents, table_of
), fractions AS (
    SELECT *, CAST(2 * (row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - 1) + 1 AS DOUBLE) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM hashed
), placed AS (
    SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM fractions
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard, CAST(place - CAST(ceil((place * 16 // total) * total / 16) AS BIGINT) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM placed
"""
