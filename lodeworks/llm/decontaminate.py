"""Benchmark decontamination: token windows of all documents against a broadcast hash set of the benchmark's n-grams.

Words are lower-cased runs without ASCII punctuation. A window is SIZE words of an item that follow each other, or the
whole item if it has fewer. Windows of items are hashed, and the hashes with their words are broadcast; windows of
documents are hashed by the same steps (pairs, fours and eights of neighbouring hashes, each made from the one before)
and looked up as they are read. A hit counts only if its words are equal, which is tested in the same pass. So a
document leaves its scan as one short row, and one more for each hit; these are all that is shuffled.

The broadcast has a bound: beyond MOST_WINDOWS windows the set is looked up in blocks, each by a scan of its own. Items
are counted by sets: windows in the same items share a set, documents with the same sets share one list of items, so
a passage that many items and many documents have isn't multiplied out.

Built-in functions only.

Cases: null and empty texts have no words and hit nothing; an item without words has no window; items with equal ids
count as one, a null id as the empty string; rows with equal or null document ids are judged each; overlapping hits count
each word once; very long texts are one row of words, their hits are sorted by Spark; empty tables give no rows or no
hits; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import LOWER, MOST_SENT, UPPER, Scratch, checkpoint

SIZE = 10
#: Windows that are sent to every task at once: some 100 bytes each.
MOST_WINDOWS = 500_000
#: What separates words, and words, before A-Z are lower-cased.
_BREAKS, _WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased, none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is quick on ASCII, and on ASCII does what is wanted.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, _BREAKS), lambda w: w != "")


def _from(array: str, first: int) -> Column:
    return F.slice(array, first, F.greatest(F.size(array), F.lit(1)))


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df with _w<n> for each n of lengths: the hashes of all n words of _words that follow each other, in order of place."""
    had = df.columns
    out = df.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    power = 1
    while 2 * power <= max(lengths):
        out = out.withColumn(f"_h{2 * power}", F.zip_with(f"_h{power}", _from(f"_h{power}", power + 1), lambda a, b: F.xxhash64(a, b)))
        power *= 2
    for n in lengths:
        powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
        own, done = F.col(f"_h{powers[0]}"), powers[0]
        for p in powers[1:]:
            own, done = F.zip_with(own, _from(f"_h{p}", done + 1), lambda a, b: F.xxhash64(a, b)), done + p
        # What reaches over the end is cut off.
        out = out.withColumn(f"_w{n}", F.slice(own, 1, F.greatest(F.size("_words") - n + 1, F.lit(0))))
    return out.select(*had, *(f"_w{n}" for n in lengths))


def windows(benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, n, hash, items) of a benchmark: each distinct window, its words' number and hash, and the sorted ids of its items."""
    own = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    each = own.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("_words"))
    each = each.groupBy("_words", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    lengths = list(range(1, size + 1))
    first = F.coalesce(*(F.when(F.col("n") == k, F.get(f"_w{k}", F.lit(0))) for k in lengths))
    return with_hashes(each, lengths).select(F.col("_words").alias("window"), "n", first.alias("hash"), "items")


def _scan(rows: DataFrame, known: DataFrame, lengths: list[int], keep_rows: bool) -> DataFrame:
    """Hits of rows (row, doc_id, text) in known (hash, window, n, set): row, doc_id, n_words, at, n, set; with keep_rows, each row once at least."""
    own = with_hashes(rows.select("row", "doc_id", words_of(F.col("text")).alias("_words")), lengths)
    own = own.select("row", "doc_id", F.size("_words").cast("long").alias("n_words"), "_words", F.concat(*(f"_w{n}" for n in lengths)).alias("_all"))
    own = own.select("row", "doc_id", "n_words", "_words", F.posexplode_outer("_all").alias("_at", "_hash"))
    # Windows of each length lie one length after the other.
    at, before = F.lit(None).cast("int"), F.lit(0)
    cases = []
    for n in lengths:
        cases.append((F.col("_at") < before + F.greatest(F.col("n_words") - n + 1, F.lit(0)), F.col("_at") - before))
        before = before + F.greatest(F.col("n_words") - n + 1, F.lit(0))
    for inside, place in reversed(cases):
        at = F.when(inside, place).otherwise(at)
    met = own.join(F.broadcast(known), F.col("_hash") == F.col("hash"), "left")
    met = met.withColumn("at", at)
    # Hashes have met; now the words must be the same.
    same = F.coalesce(F.col("window") == F.slice("_words", (F.col("at") + 1).cast("int"), F.col("n")), F.lit(False))
    first = F.coalesce(F.col("_at") == 0, F.lit(True))
    met = met.withColumn("same", same).filter((F.col("same") | first) if keep_rows else F.col("same"))
    return met.select("row", "doc_id", "n_words", *(F.when(F.col("same"), F.col(c)).alias(c) for c in ("at", "n", "set")))


def _hits(rows: DataFrame, benchmark: DataFrame, scratch: Scratch, size: int, item_col: str, item_text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(hits of _scan with each row once at least, sets of items by number) for rows (row, doc_id, text)."""
    found = scratch.keep(windows(benchmark, size, item_col, item_text), "windows")
    sets = scratch.keep(found.select("items").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    known = scratch.keep(found.join(sets, "items").select("hash", "window", "n", "set"), "known")
    lengths = sorted(r.n for r in known.select("n").distinct().collect()) or [size]
    parts = -(-known.count() // most) or 1
    if parts > 1:  # several scans must see the same numbers of rows
        rows = scratch.keep(rows, "rows")
    block = F.pmod(F.col("hash"), F.lit(parts))
    each = [scratch.keep(_scan(rows, known.filter(block == k), lengths, k == 0), f"hits{k}") for k in range(parts)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out, sets


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _covered(hits: DataFrame) -> DataFrame:
    """hits with end, and with new: the words of a hit that no earlier hit of its row has."""
    end = (F.col("at") + F.col("n")).cast("long")
    before = F.max("end").over(W.partitionBy("row").orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1))
    out = hits.withColumn("end", end).withColumn("reached", before)
    return out.withColumn("new", F.coalesce(F.greatest(F.col("end") - F.greatest("at", F.coalesce("reached", F.lit(0))), F.lit(0)), F.lit(0)))


def judge(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST_WINDOWS) -> DataFrame:
    """Each document's doc_id, n_words, n_hit (words inside an item's window), n_items, items_sha256 and contaminated."""
    with Scratch(docs.sparkSession) as scratch:
        hits, sets = _hits(_rows(docs, id_col, text_col), benchmark, scratch, size, item_col, item_text, most)
        own = _covered(hits).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("new").cast("long").alias("n_hit"), F.sort_array(F.collect_set("set")).alias("sets"))
        own = scratch.keep(own.withColumn("key", F.sha2(F.array_join(F.transform("sets", lambda s: s.cast("string")), ","), 256)), "verdicts")
        # One list of items for all documents with the same sets.
        dirty = own.filter("n_hit > 0")
        each = dirty.groupBy("key").agg(F.first("sets").alias("sets")).select("key", F.explode("sets").alias("set"))
        each = each.join(sets, "set").select("key", F.explode("items").alias("item")).distinct()
        lists = each.groupBy("key").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
        lists = scratch.keep(lists, "lists")
        if lists.count() <= MOST_SENT:
            lists = F.broadcast(lists)
        clean = own.filter("n_hit = 0").select("doc_id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
        out = dirty.join(lists, "key").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").unionByName(clean)
        return checkpoint(out.withColumn("contaminated", F.col("n_hit") > 0))


def clean(docs: DataFrame, benchmark: DataFrame, drop: str = "spans", size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MOST_WINDOWS) -> DataFrame:
    """docs without what the benchmark has: drop="spans" cuts the words hit, each with what separates it from the next word; drop="documents" leaves out documents with a hit."""
    if drop not in ("spans", "documents"):
        raise ValueError(f"can't drop {drop}")
    had, row = docs.columns, f"_row{uuid.uuid4().hex}"
    with Scratch(docs.sparkSession) as scratch:
        numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
        rows = numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        hits, _ = _hits(rows, benchmark, scratch, size, item_col, item_text, most)
        hits = _covered(hits.filter(F.col("at").isNotNull()))
        # Hits that touch make one island.
        step = F.when(F.col("at") <= F.col("reached"), 0).otherwise(1)
        islands = hits.withColumn("island", F.sum(step).over(W.partitionBy("row").orderBy("at", "end"))).groupBy("row", "island").agg(F.min("at").alias("at"), F.max("end").alias("end"))
        dirty = islands.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("_islands"))
        dirty = scratch.keep(dirty.withColumnRenamed("row", "_row"), "islands")
        small = dirty.count() <= MOST_SENT // 10
        dirty = F.broadcast(dirty) if small else dirty
        own = F.col(row) == F.col("_row")
        if drop == "documents":
            return checkpoint(numbered.join(dirty, own, "left_anti").select(*(F.col(f"`{c}`") for c in had)))
        out = numbered.join(dirty, own, "left")
        return checkpoint(out.select(*(F.coalesce(_without(F.col(f"`{c}`"), F.col("_islands")), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in had)))


def _without(text: Column, islands: Column) -> Column:
    """text without the words from at to end of each island; null without islands. Islands are in order and don't touch."""
    words = F.regexp_extract_all(text, F.lit(f"({_WORDS})"), F.lit(1))
    gaps = F.split(text, _WORDS)
    # Word i with the gap behind it; the gap before the first word stays.
    pairs = F.zip_with(words, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda w, g: F.concat(w, g))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(islands, lambda x: x["end"]))
    ends = F.concat(F.transform(islands, lambda x: x["at"].cast("long")), F.array(F.size(words).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice(pairs, (a + 1).cast("int"), (b - a).cast("int")), ""))
    return F.when(islands.isNotNull(), F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, "")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document has of the benchmark's windows."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return judge(docs, benchmark)


_DUCK_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH own AS (
    SELECT row_number() OVER () AS row, doc_id, {_DUCK_WORDS} AS w FROM documents
), items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_DUCK_WORDS} AS w FROM benchmark
), known AS (
    SELECT DISTINCT item, n, w[i:i + n - 1] AS part FROM (SELECT item, w, least(len(w), {SIZE}) AS n, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM known
), parts AS (
    SELECT row, n, i, w[i:i + n - 1] AS part FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM own, lengths WHERE len(w) >= n)
), hits AS (
    SELECT row, item, i, n FROM parts JOIN known USING (n, part)
), words_hit AS (
    SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT row, i, n FROM hits)) GROUP BY row
), items_hit AS (
    SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM own LEFT JOIN words_hit USING (row) LEFT JOIN items_hit USING (row)
"""
