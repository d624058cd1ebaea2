"""Importance resampling towards a target distribution over hashed n-grams.

A feature is a run of one or two words; it is counted in the bucket that its CRC-32 names. In each partition DuckDB takes
texts apart: words are unnested, a window gives each its successor, and a registered function hashes the features.
What leaves the partition, and is spilled to Parquet, are counts by bucket: for each document, and one row for the whole
partition. Spark adds up the partitions' rows of the corpus and of the target, which gives each bucket a gain in the
logarithm of its likelihood; a document's weight is the mean gain of its features. Gumbel noise by a hash of the id
turns the largest weights into a draw without replacement.

The draw is exact and spread out: scores are whole numbers in a narrow range, so counts by score tell the lowest score
drawn; rows from there on are ranked by ranges. No text is shuffled.

Long texts are cut between words into blocks that DuckDB gets one after the other, each with the last word of the block
before, so that memory has a bound and no feature is lost.

Cases: a null text has no words; without features the weight is 0; ties in the score go to the smaller id, null ids
after all others; rows with equal ids are weighed, and drawn, each for itself; an empty corpus gives no rows and an
empty target takes all its counts as 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import LOWER, UPPER, Scratch, checkpoint
from lodeworks.operators.ranking import ranked

BUCKETS = 10_000
#: Words that a document needs to be drawn, the documents drawn of 100, and the seed.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: What words are made of, after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Code points that DuckDB gets at once; longer texts are cut between words.
_BLOCK = 1_000_000
_COUNTED = "doc_id bigint, of_partition boolean, n_words bigint, buckets array<int>, times array<bigint>"
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
_BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_BREAK = re.compile(f"[{re.escape(_BREAKS)}]")

#: Per row of block: its new words, and how often it has each bucket. The first word of a row that carries on is the last one of the block before.
_FEATURES = f"""
WITH words AS (
    SELECT row, carried, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT row, carried, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM block)
), runs AS (
    SELECT row, word, NOT (carried AND pos = 1) AS own, lead(word) OVER (PARTITION BY row ORDER BY pos) AS next FROM words
), features AS (
    SELECT row, 1 AS words, word AS feature FROM runs WHERE own
    UNION ALL
    SELECT row, 0, word || ' ' || next FROM runs WHERE next IS NOT NULL
), hashed AS (
    SELECT row, words, crc32(feature) % {{buckets}} AS bucket FROM features
), counted AS (
    SELECT row, bucket, sum(words) AS words, count(*) AS times FROM hashed GROUP BY ALL
)
SELECT row, CAST(sum(words) AS BIGINT) AS n_words, CAST(list(bucket ORDER BY bucket) AS INTEGER[]) AS buckets, CAST(list(times ORDER BY bucket) AS BIGINT[]) AS times
FROM counted GROUP BY row ORDER BY row
"""


def _crc32(features: pa.Array) -> pa.Array:
    features = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    _, offsets, data = features.cast(pa.large_binary()).buffers()
    at = np.frombuffer(offsets, np.int64)[features.offset : features.offset + len(features) + 1].tolist()
    text = data.to_pybytes() if data else b""
    return pa.array([zlib.crc32(text[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.uint32())


def blocks(text: str, size: int = _BLOCK):
    """(text, carried) of a text's blocks of size or more code points, cut where no word is; carried: the first word is the last of before."""
    start, last = 0, ""
    while len(text) - start > size:
        end = _BREAK.search(text, start + size)
        if end is None:
            break
        own = f"{last} {text[start : end.start()]}" if last else text[start : end.start()]
        yield own, bool(last)
        own = own.rstrip(_BREAKS)
        last, start = own[max(map(own.rfind, _BREAKS)) + 1 :] or last, end.start()
    yield (f"{last} {text[start:]}" if last else text[start:]), bool(last)


class Counter:
    """DuckDB in one task, without threads of its own or files."""

    def __init__(self, buckets: int):
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "400MB", "temp_directory": ""})
        self.con.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
        self.sql = _FEATURES.format(buckets=buckets)

    def count(self, texts: list[str], carried: list[bool]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(row, new words, buckets, times) of the texts that have a feature."""
        self.con.register("block", pa.table({"row": pa.array(range(len(texts)), pa.int64()), "carried": carried, "text": pa.array(texts, pa.string())}))
        out = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("block")
        row, words, buckets, times = (out.column(name).combine_chunks() for name in ("row", "n_words", "buckets", "times"))
        cut, b, t = buckets.offsets.to_numpy(), buckets.values.to_numpy(), times.values.to_numpy()
        return [(r, n, b[i:j], t[i:j]) for r, n, i, j in zip(row.to_pylist(), words.to_pylist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _count_all(buckets: int):
    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=names)

    def run(batches):
        counter, whole, n_words = Counter(buckets), np.zeros(buckets, np.int64), 0

        def counted(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = {r: x for r, *x in counter.count(texts, [False] * len(texts))}
            return rows_of([(i, False, *found.get(r, (0, [], []))) for r, i in enumerate(ids)])

        def long(i, text: str) -> pa.RecordBatch:
            sums, n = np.zeros(buckets, np.int64), 0
            for own, carried in blocks(text):
                for _, words, b, t in counter.count([own], [carried]):
                    n += words
                    sums[b] += t
            at = np.flatnonzero(sums)
            return rows_of([(i, False, n, at, sums[at])])

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal n_words
            np.add.at(whole, batch.column("buckets").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
            n_words += sum(batch.column("n_words").to_pylist())
            return batch

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                i, text = i.as_py(), text.as_py()
                if len(text) > _BLOCK:
                    yield out(long(i, text))
                    continue
                if held + len(text) > _BLOCK:
                    yield out(counted(ids, texts))
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield out(counted(ids, texts))
        at = np.flatnonzero(whole)
        yield rows_of([(None, True, n_words, at, whole[at])])

    return run


def counted(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document, and one for each partition (of_partition): n_words, and how often which bucket is met."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_count_all(buckets), _COUNTED)


def _merged(rows: DataFrame, name: str) -> DataFrame:
    """Counts by bucket of all partitions."""
    each = rows.filter("of_partition").select(F.explode(F.arrays_zip("buckets", "times")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.times").alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, 1000 times the logarithm of how much likelier the target has it, rounded down; both counts are raised by one."""
    both = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for rows, name in ((own, "s"), (target, "t")):
        both = both.join(_merged(rows, name), "bucket", "left")
    both = checkpoint(both.na.fill(0))
    size, wanted = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(size + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(wanted + buckets)))
    # One row a bucket: a fixed number of rows, whatever the corpus.
    return [r.gain for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def weighed(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of counted() rows."""
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # a constant, folded once
    total = F.aggregate(F.zip_with("buckets", "times", lambda b, n: F.get(known, b) * n), F.lit(0).cast("long"), lambda s, x: s + x)
    features = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("long")
    out = rows.filter("NOT of_partition").select("doc_id", "n_words", features.alias("n_features"), total.alias("_sum"))
    mean = F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) DIV n_features")).otherwise(0).cast("long")
    out = out.withColumn("weight", mean)
    return out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate by a hash of the id, rounded down."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(key, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Each document's doc_id, n_words, n_features, weight, score, and rank among those drawn (null: not drawn).

    percent of the documents with least_words words or more are drawn, rounded down, by falling score.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(counted(docs, buckets, id_col, text_col), "counts")
        wanted = scratch.keep(counted(target.withColumn("_no_id", F.lit(None).cast("long")), buckets, "_no_id", target_text).filter("of_partition"), "target")
        scored = scratch.keep(weighed(rows, gains(rows, wanted, buckets), seed), "scores")
        may = F.col("n_words") >= least_words
        # Scores are whole numbers within some tens of thousands: gains are logarithms of counts, noise lies between -3200 and 23000.
        by_score = scored.filter(may).groupBy("score").count().collect()
        left = draw = percent * sum(r["count"] for r in by_score) // 100
        lowest = None
        for r in sorted(by_score, reverse=True):
            if left <= 0:
                break
            lowest, left = r.score, left - r["count"]
        if lowest is None:
            return checkpoint(scored.withColumn("rank", F.lit(None).cast("long")))
        high = may & (F.col("score") >= lowest)
        drawn = ranked(scored.filter(high), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
        drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
        return checkpoint(drawn.unionByName(scored.filter(~high).withColumn("rank", F.lit(None).cast("long"))))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score, and its rank among the quarter that is drawn."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH own AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w, true AS mine FROM documents
    UNION ALL
    SELECT NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'), false FROM benchmark
), words AS (
    SELECT row, mine, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM own
), features AS (
    SELECT row, mine, word AS feature FROM words
    UNION ALL
    SELECT * FROM (SELECT row, mine, word || ' ' || lead(word) OVER (PARTITION BY row ORDER BY pos) AS feature FROM words) WHERE feature IS NOT NULL
), table_of AS (
    SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(n))
), bytes AS (
    SELECT feature, list_transform(range(octet_length(encode(feature))), lambda i: CAST('0x' || substr(hex(encode(feature)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT feature FROM features)
), hashed AS (
    SELECT feature, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(crcs[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM bytes, table_of
), counted AS (
    SELECT row, mine, bucket FROM features JOIN hashed USING (feature)
), by_bucket AS (
    SELECT bucket, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t FROM counted GROUP BY bucket
), totals AS (
    SELECT coalesce(sum(s), 0) AS size, coalesce(sum(t), 0) AS wanted FROM by_bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(size + {BUCKETS} AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(wanted + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM by_bucket, totals
), weights AS (
    SELECT row, count(*) AS n_features, sum(gain) AS total FROM counted JOIN gains USING (bucket) WHERE mine GROUP BY row
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
           CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
           CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM own LEFT JOIN weights USING (row) WHERE mine
), noisy AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS n FROM noisy
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
