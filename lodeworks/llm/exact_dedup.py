"""Exact deduplication against a persistent digest index.

The index holds the SHA-256 digest of each text kept so far, with the id of its document and of the batch it came in. It
is a list of runs, Parquet tables bucketed and sorted by the digest, one file a bucket. A batch is grouped by digest,
its groups are anti-joined with each run by sort-merge join, and what no run has is appended as a run of its own.
Verdicts are then looked up in the index itself. Nothing but digests and ids is shuffled, and the index side of the
joins is neither shuffled nor sorted. Beyond MOST_RUNS runs the index is compacted into one.

A manifest names the runs and the number of buckets. It is published, as a new file, after the batch's verdicts have been
computed and saved; what a lost driver leaves before that is not in the index. Give a batch a name to make retries
safe: a batch of the same name finds its own digests and gets the verdicts that it got before. One writer at a time.

Cases: a null text counts as the empty text; of equal texts in a batch the row with the largest id stays, unless the
index has the digest from another batch already, in which case none does; null ids are smaller than all others;
repeated (id, text) rows count as members of their group and share its verdict (all of them carry the id that stays);
very long texts are digested whole; an empty batch gives an empty result; other columns, whatever their names, are not
touched.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint, remove, without

_COLUMNS = "digest binary, keep_id bigint, batch string"
#: Runs that an index has at most before it is compacted.
MOST_RUNS = 8


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and the digest of its text, unchanged, in UTF-8."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"))


class DigestIndex:
    """The digests of all texts kept so far, at a path that outlives the session. Use as a context manager, or call close()."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: of a new index (as many as shuffle partitions, if not given); one that exists keeps its own number."""
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {}
        found = self._manifests()
        if found:
            saved = json.loads(spark.read.text(f"{self.path}/manifests/{found[-1]}", wholetext=True).first()[0])
            if buckets not in (None, saved["buckets"]):
                raise ValueError(f"the index has {saved['buckets']} buckets, not {buckets}")
            self.version, self.buckets, self.runs = int(found[-1].split(".")[0]), saved["buckets"], saved["runs"]
        else:
            self.version, self.runs = 0, []
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[str]:
        fs, at = self._at("manifests")
        return sorted(str(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def _publish(self, runs: list[str]) -> None:
        """A new manifest under the next number: written beside, then renamed, which fails if another writer was first."""
        data = json.dumps({"buckets": self.buckets, "runs": runs})
        fs, new = self._at(f"manifests/{uuid.uuid4().hex}.new")
        out = fs.create(new, False)
        out.write(bytearray(data.encode()))
        out.close()
        if not fs.rename(new, self._at(f"manifests/{self.version + 1:09d}.json")[1]):
            raise OSError("another writer has changed the index")
        self.version, self.runs = self.version + 1, runs

    def _table(self, run: str) -> str:
        if run not in self.tables:
            self.tables[run] = f"digest_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[run]} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.tables[run]

    def close(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}

    @contextlib.contextmanager
    def _sorted_scans(self) -> Iterator[None]:
        """Within, a bucket that is one file counts as sorted, as it is."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], _COLUMNS)
        for run in self.runs if runs is None else runs:
            out = out.unionByName(self.spark.table(self._table(run)))
        return out

    def _write(self, rows: DataFrame) -> str:
        """A run that no manifest has yet: one sorted file for each bucket."""
        run = f"run-{uuid.uuid4().hex}"
        rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self._table(run))
        return run

    def compact(self) -> None:
        """All runs as one."""
        old = self.runs
        self._publish([self._write(self.rows())])
        for run in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")
            remove(self.spark, f"{self.path}/{run}")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """Those of the distinct digests that no run has."""
        for run in self.runs:
            groups = groups.join(self.spark.table(self._table(run)).select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Each document's verdict: doc_id, keep_id, group_size (in this batch), kept, digest. New digests are added to the index.

        keep_id is the id that stays, from an earlier batch if the index had the digest. batch: a name for retries.
        """
        batch = batch or uuid.uuid4().hex
        if not self.runs:
            self._publish([self._write(self.rows())])
        elif len(self.runs) > MOST_RUNS:
            self.compact()
        own = checkpoint(digests(docs, id_col, text_col))
        groups = checkpoint(own.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("group_size")))
        with self._sorted_scans():
            fresh = checkpoint(self.unknown(groups).select("digest", F.col("last_id").alias("keep_id"), F.lit(batch).alias("batch")))
            runs = self.runs if fresh.isEmpty() else [*self.runs, self._write(fresh)]
            # Each digest is in one run. Both sides of the last join come from files, so that Spark may split a digest with very many rows.
            hits = [groups.join(self.spark.table(self._table(run)).hint("merge"), "digest").select("digest", "group_size", "keep_id", (F.col("batch") == batch).alias("fresh")) for run in runs]
            verdicts = hits[0]
            for hit in hits[1:]:
                verdicts = verdicts.unionByName(hit)
            verdicts = checkpoint(verdicts)
        out = checkpoint(own.join(verdicts, "digest").select("doc_id", "keep_id", "group_size", (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "digest"))
        if runs != self.runs:
            self._publish(runs)
        return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dedup() of one batch against an index of its own."""
    with Scratch(docs.sparkSession) as scratch, DigestIndex(docs.sparkSession, f"{scratch.path}/index") as index:
        return index.dedup(docs, id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each set of equal texts, that with the largest id, with all columns; one of rows that share id and text."""
    verdicts = exact_dedup(docs, id_col, text_col)
    away = verdicts.filter(~F.col("kept")).select("doc_id", "digest")
    again = verdicts.filter("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "digest")
    return without(docs, {"doc_id": F.col(id_col).cast("long"), "digest": _digest(text_col)}, away, again)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document: of equal texts, that with the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
