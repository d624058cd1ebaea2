"""Scratch tables, checkpoints and column helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys that are sent to every task at most.
MOST_SENT = 1_000_000

_left: set[str] = set()


def kept_in_process(name: str, make: Callable):
    """What make() gives, made once in each Python process and kept from task to task.

    Functions are shipped to tasks by value, so their own globals are new in each task. A module of this name, which
    exists in memory only, is what stays.
    """
    kept = vars(sys.modules.setdefault("lodeworks_kept", types.ModuleType("lodeworks_kept")))
    if name not in kept:
        kept[name] = make()
    return kept[name]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine a temporary one stands in for it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.discard(path)


class Scratch:
    """A folder for the large tables of one call. Use as a context manager, or call drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/lodeworks-{uuid.uuid4().hex}"
        _left.add(self.path)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df once and read it back, which also cuts its lineage."""
        df.write.mode("overwrite").option("compression", compression).parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        remove(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def clear(spark: SparkSession, but: str = "") -> None:
    """Delete the folders of scratch tables that are left, for results that have been written by now."""
    for path in list(_left - {but}):
        with contextlib.suppress(Exception):
            remove(spark, path)


@atexit.register
def _clean() -> None:
    clear(SparkSession.getActiveSession())


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; Spark deletes its files once nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def without(docs: DataFrame, key: dict[str, Column], away: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose key is in away, and with one row only of each key that is in again; nulls are equal.

    key: the columns of away and again, by name, as expressions over docs. Texts are not shuffled while the keys to drop
    are few enough to be sent to every task, which is counted first; beyond that docs are joined by a shuffle.
    """
    had, name = docs.columns, f"_key{uuid.uuid4().hex}"
    keyed = docs.withColumn(name, F.struct(*(c.alias(n) for n, c in key.items())))

    def sent(keys: DataFrame) -> DataFrame:
        keys = checkpoint(keys.select(*(F.col(n) for n in key)).distinct())
        small = keys.count() <= MOST_SENT
        keys = keys.select(F.struct(*key).alias("_away"))
        return F.broadcast(keys) if small else keys

    if again is not None and not again.isEmpty():
        again = sent(again)
        same = F.col(name).eqNullSafe(F.col("_away"))
        keyed = keyed.join(again, same, "left_anti").unionByName(keyed.join(again, same, "left_semi").dropDuplicates([name]))
    away = sent(away)
    return keyed.join(away, F.col(name).eqNullSafe(F.col("_away")), "left_anti").select(*(F.col(f"`{c}`") for c in had))


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of an ASCII set a text has."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def spread(rows: int, per_part: int, least: int = 8) -> int:
    """Partitions, or key ranges, for so many rows."""
    return max(least, -(-rows // per_part))
