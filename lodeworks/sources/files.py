"""Files of a source tree as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.hashing import sha
from lodeworks.functions.paths import basename, extension, selected
from lodeworks.functions.text import line_count
from lodeworks.operators.classify import file_category, language

MOST_BYTES, MOST_BYTES_CONFIG = 2 << 20, 10 << 20


def encoding(content: Column) -> Column:
    """UTF-16LE or UTF-8 by byte-order mark, binary with a NUL, UTF-8 if valid, else unknown."""
    head = F.hex(F.substring(content, 1, 3))
    valid = F.is_valid_utf8(content.cast("string")) & ~content.cast("string").contains("�")
    return F.when(head.startswith("FFFE"), "UTF-16LE").when(head == "EFBBBF", "UTF-8 BOM").when(F.hex(content).rlike("^(..)*00"), "binary").when(valid, "UTF-8").otherwise("unknown")


#: The share of NUL bytes above which a text without a mark is taken for UTF-16, and how many bytes tell. Fixed values.
NUL_SHARE, PROBE = 0.2, 200


def event_text(content: Column) -> Column:
    """The text of a log of unknown origin: UTF-16LE by its mark or by the NUL bytes among its first PROBE, else UTF-8 with or without a mark."""
    # Two hexadecimal digits a byte, set apart so that zeros of neighbours don't count.
    first = F.substring(content, 1, PROBE)
    zeros = F.regexp_count(F.regexp_replace(F.hex(first), "(..)", "$1 "), F.lit("00 "))
    wide = zeros > NUL_SHARE * F.octet_length(first)
    head, body = F.hex(F.substring(content, 1, 3)), lambda skip: F.substring(content, skip + 1, 1 << 30)
    return F.when(head.startswith("FFFE"), F.decode(body(2), "UTF-16LE")).when(wide, F.decode(content, "UTF-16LE")).when(head == "EFBBBF", body(3).cast("string")).otherwise(F.make_valid_utf8(content.cast("string")))


def blob_id(content: Column) -> Column:
    """The object id that version control gives a file's content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\x00")), "UTF-8"), content))


def listed_objects(listing: DataFrame, column: str = "output") -> DataFrame:
    """(path, mode, object_id) of NUL-separated listings of tracked files, with or without their stages; without, the id is null.

    A path that is listed more than once keeps an id if it has one.
    """
    rows = listing.select(F.explode(F.filter(F.split(F.col(column), "\x00"), lambda x: x != "")).alias("x"))
    staged = r"^(\d+)\s+([a-f0-9]{40,64})\s+\d+\t(.+)$"
    at = lambda g: F.nullif(F.regexp_extract("x", staged, g), F.lit(""))
    rows = rows.select(F.replace(F.coalesce(at(3), F.col("x")), F.lit("\\"), F.lit("/")).alias("path"), at(1).alias("mode"), at(2).alias("object_id"))
    return rows.groupBy("path").agg(F.max("mode").alias("mode"), F.max("object_id").alias("object_id"))


def to_read(tracked: DataFrame, known: DataFrame) -> DataFrame:
    """Of tracked files (path, object_id) those that must be read: no file of known (path, object_id) has their content at their path."""
    same = [F.col("a.path") == F.col("b.path"), F.col("a.object_id") == F.col("b.object_id")]
    return tracked.alias("a").join(known.alias("b"), same, "left_anti")


def decoded(content: Column, kind: Column) -> Column:
    body = lambda skip: F.substring(content, skip + 1, 1 << 30)
    return F.when(kind == "UTF-16LE", F.decode(body(2), "UTF-16LE")).when(kind == "UTF-8 BOM", body(3).cast("string")).when(kind == "UTF-8", content.cast("string"))


def scan_tree(spark: SparkSession, root: str, includes: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """The files entity of a tree: filtered by path first, and contents looked at only up to the size limit of the category.

    Files beyond MOST_BYTES_CONFIG are listed with a warning and without a digest; a file beyond 2 GB can't be read as a row.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    at = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rows = raw.withColumn("path", F.substring(at, len(base.removeprefix("file://")) + 2, 1 << 20)).filter(selected(F.col("path"), includes or [], excludes or []))
    rows = rows.withColumn("category", file_category(F.col("path")))
    fits = F.col("length") <= F.when(F.col("category").isin("manifest", "config", "build"), MOST_BYTES_CONFIG).otherwise(MOST_BYTES)
    rows = rows.withColumn("encoding", F.when(fits, encoding(F.col("content")))).withColumn("text", F.when(fits, decoded(F.col("content"), F.col("encoding"))))
    warning = F.when(~fits, "too large: content not read").when(F.col("encoding") == "unknown", "encoding not recognised")
    return rows.select(F.concat(F.lit("file-"), sha(F.col("path"), 16)).alias("id"), "path", basename(F.col("path")).alias("basename"), extension(F.lower("path")).alias("extension"), "category", language(F.col("path")).alias("language"),
                       F.col("length").alias("size_bytes"), line_count(F.col("text")).alias("line_count"), F.when(fits, F.sha2("content", 256)).alias("sha256"), F.col("text").isNotNull().alias("is_text"), "encoding", (F.col("category") == "generated").alias("generated"), F.array_compact(F.array(warning)).alias("warnings"), "text")


def porcelain(status: DataFrame, column: str = "output", by: list[str] | None = None) -> DataFrame:
    """Changed files of NUL-separated version-control status texts: a rename or copy record is followed by its old path.

    Columns of by go with each file. Ignored files are no changes.
    """
    parts, by = F.filter(F.split(F.col(column), "\x00"), lambda x: x != ""), by or []
    rows = status.select(*by, parts.alias("p")).select(*by, "p", F.posexplode("p").alias("i", "x"))
    before = F.get("p", F.col("i") - 1)
    # A record is an old path exactly if the one before it is a rename or copy record that isn't an old path itself.
    renames = lambda x: x.rlike("^(R.|.R|C.|.C) ")
    rows = rows.filter(F.coalesce(~renames(before), F.lit(True)) & ~F.col("x").startswith("!! "))
    code = F.substring("x", 1, 2)
    kind = F.when(code == "??", "untracked").when(renames(F.col("x")), "renamed").when(code.contains("D"), "deleted").when(code.contains("A"), "added").otherwise("modified")
    return rows.select(*by, F.substring("x", 4, 1 << 20).alias("path"), kind.alias("status"), F.when(renames(F.col("x")), F.get("p", F.col("i") + 1)).alias("old_path"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file below a folder, paths relative to it."""
    base = root.rstrip("/")
    at = F.regexp_replace(F.col("path"), "^file:/+", "/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return raw.select(F.substring(at, len(base.removeprefix("file://")) + 2, 1 << 20).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, fault): files that are missing, changed, or not in the manifest."""
    a, b = expected.select("path", F.col("sha256").alias("_a")), found.select("path", F.col("sha256").alias("_b"))
    both = a.join(b, "path", "full_outer")
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault is not null")
