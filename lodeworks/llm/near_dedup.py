"""Near-duplicate documents by MinHash: one permutation with optimal densification, banded buckets, star-shaped edges.

1. Each text becomes its set of word shingles (64-bit hashes). One hash a shingle fills all BINS of the signature: the
   high bits name the bin, the smallest hash in a bin is its value, and an empty bin takes the value of the first
   filled one in an order that depends on the bin only. Equal sets are one class from here on, represented by the
   smallest id.
2. The first BANDS * ROWS bins make BANDS bucket keys. Texts of similarity 0.8 miss each other in all 32 bands with
   probability 5e-8.
3. In each bucket the class that meets most others is the centre, and every class of the bucket is linked with it
   only: one candidate at most a class and bucket, whatever the bucket's size. Candidates are confirmed on full sets.
4. What stars can't see is swept up: in buckets that still hold several components, the classes outside the bucket's
   largest component are compared with all of the bucket, tile by tile, by sketches of up to SKETCH hashes. Sets that
   fit a sketch are compared exactly, larger ones within 5 standard deviations. A tile proposes one pair for two
   components that are surely linked, and all pairs that aren't sure; these are confirmed on full sets as well.
   A bucket in which this would take more than MOST_PAIRS comparisons, such as one of a common passage, is first cut
   into finer ones: its key is extended by CHOSEN other groups of ROWS bins, one at a time, and so again for LEVELS
   levels. Texts of similarity 0.8 in a bucket miss each other in all of them with probability 2e-4, and share 13
   buckets on average, which choose their groups differently; overall that adds less than the bands' own 5e-8.
5. Components by alternating large-star and small-star steps on the confirmed links, until nothing changes.

Set sizes, links and components are exact but for the probabilities named, and for 64-bit hashes that agree by chance.

Cases: null, empty and wordless texts have the empty set, n_shingles 0, and are linked with nothing, not even each
other; a text with fewer words than a shingle has one shingle, the whole sequence; repeated rows yield a row each; texts
that share an id are told apart, and have the component of their own text; null ids are larger than all others; very long
texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm.common import LOWER, MOST_SENT, UPPER, Scratch, checkpoint, without

BINS, BANDS, ROWS = 256, 32, 4
_SHIFT = np.uint64(64 - 8)
#: For each bin, the order in which it asks the others for a value.
_ASK = np.array([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)]).astype(np.int16)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes in a sketch.
SKETCH = 512
#: Rows on one side of a tile.
TILE = 1024
#: Comparisons that a bucket is swept with at most before it is cut into finer ones, and how that is done.
MOST_PAIRS, CHOSEN, LEVELS = 4 * TILE * TILE, 16, 3


class _Hashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _stir(out * _MIX + h[i : len(words) - k + 1 + i])
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """The BINS values of a sorted set that isn't empty."""
    starts = np.searchsorted(sets, np.arange(BINS, dtype=np.uint64) << _SHIFT)
    ends = np.append(starts[1:], len(sets))
    filled = ends > starts
    value = np.where(filled, sets[np.minimum(starts, len(sets) - 1)], np.uint64(0))
    if not filled.all():
        empty = np.flatnonzero(~filled)
        asks = _ASK[empty]
        value[empty] = value[asks[np.arange(len(empty)), filled[asks].argmax(1)]]
    return value


def band_keys(value: np.ndarray, bands: int = BANDS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in value[: bands * ROWS].reshape(bands, ROWS).T:
        key = _stir(key * _MIX + column)
    return key.view(np.int64)


def set_hash(sets: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(sets.tobytes()) - (1 << 63)


_SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, rep bigint, keys array<bigint>"


def _signed(size: int):
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for part in (batch.slice(lo, 512) for lo in range(0, batch.num_rows, 512)):
                sets = [shingle_set(text, size, hashes) for text in part.column(2).to_pylist()]
                made = [[len(s) for s in sets], [set_hash(s) if len(s) else None for s in sets], [band_keys(signature(s)) if len(s) else None for s in sets]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True))], names=["doc_id", "text_hash", "n_shingles", "rep", "keys"])
    return run


def sketch(sets: np.ndarray) -> np.ndarray:
    """The SKETCH smallest of a set's hashes, 32 bits of each, in order: the whole set if it isn't larger."""
    own = np.unique((_stir(sets) >> np.uint64(32)).astype(np.uint32))
    return own[:SKETCH]


#: What texts are shingled again for: their full sets, sketches of these, or keys of all groups of bins.
_AGAIN = {"whole": lambda s: s.tobytes(), "sketch": lambda s: sketch(s).tobytes(), "finer": lambda s: band_keys(signature(s), BINS // ROWS).tobytes()}


def _shingled(size: int, what: str):
    """Documents to (rep, what is asked for, as bytes)."""
    def run(batches):
        hashes, make = _Hashes(), _AGAIN[what]
        for batch in batches:
            for part in (batch.slice(lo, 512) for lo in range(0, batch.num_rows, 512)):
                sets = [s for text in part.column("text").to_pylist() if len(s := shingle_set(text, size, hashes))]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([make(s) for s in sets], pa.binary())], names=["rep", "shingles"])
    return run


def _overlap(batches):
    """(a, b, sets of a and b) to (a, b, size of the intersection and of the union)."""
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        both, either = [], []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            both.append(common)
            either.append(len(p) + len(q) - common)
        yield pa.RecordBatch.from_arrays([a, b, pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])


def _sets(texts: DataFrame, reps: DataFrame, named: DataFrame, size: int, what: str = "whole") -> DataFrame:
    """rep and what is asked for of the classes in named (rep, distinct); one text of each is shingled again."""
    where = checkpoint(reps.join(named, "rep", "left_semi").select("doc_id", "text_hash"))
    where = F.broadcast(where) if where.count() <= MOST_SENT else where
    same = texts["doc_id"].eqNullSafe(where["doc_id"]) & (texts["text_hash"] == where["text_hash"])
    return texts.join(where, same, "left_semi").select("text").mapInArrow(_shingled(size, what), "rep bigint, shingles binary").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar enough."""
    sizes = reps.select("rep", "n_shingles")
    fit = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb")), "b")
    fit = checkpoint(fit.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    sets = scratch.keep(_sets(texts, reps, fit.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), size), f"{name}_sets")
    both = fit.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return scratch.keep(both.mapInArrow(_overlap, "a bigint, b bigint, both bigint, either bigint").filter(100 * F.col("both") >= percent * F.col("either")).select("a", "b"), name)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the undirected links (a, b): the smallest node that is reachable.

    Large-star and small-star steps alternate until nothing changes; each is a few shuffles of the links.
    """
    links = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
        large = links.join(low, links["v"] == low["n"]).select("u", "m").union(links.join(low, links["u"] == low["n"]).filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("m")))
        large = large.filter("u <> m").select("u", F.col("m").alias("v")).distinct()
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = checkpoint(small.filter("u <> v").distinct())
        after = mark(links)
        if after == before:
            break
        before = after
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    return checkpoint(roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct()))


class Sketches:
    """Sketches side by side, to compare one with all."""

    def __init__(self, sketches: list[np.ndarray], n: np.ndarray):
        flat = np.concatenate(sketches)
        self.values, self.number = np.unique(flat, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in sketches])))
        whole = n <= SKETCH
        # Up to its last value a sketch has all of its set; up to any value if it is the whole set.
        self.upto = np.where(whole, np.uint32(0xFFFFFFFF), flat[self.starts[1:] - 1])
        self.whole = whole

    def compare(self, i: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """For all sketches whether their similarity with that of i may reach share, and whether it surely does (by 5 standard deviations, or exactly for whole sets)."""
        own = self.number[self.starts[i] : self.starts[i + 1]]
        member = np.zeros(len(self.values), bool)
        member[own] = True
        low = self.number <= np.searchsorted(self.values, self.upto[i], "right") - 1
        both = np.add.reduceat(member[self.number] & low, self.starts[:-1])
        either = np.add.reduceat(low, self.starts[:-1]) + np.searchsorted(self.values[own], np.minimum(self.upto, self.upto[i]), "right") - both
        slack = np.where(self.whole & self.whole[i], 0.0, 5 * np.sqrt(share * (1 - share) / either)) * either
        return both >= share * either - slack - 1e-9, both >= share * either + slack - 1e-9


def _tile(percent: int):
    share = percent / 100

    def run(key, table):
        side = np.asarray(table.column("p_side").combine_chunks().to_numpy(zero_copy_only=False))
        rep, comp, n, band = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "band"))
        sets = Sketches([np.frombuffer(x, np.uint32) for x in table.column("shingles").to_pylist()], n)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        group = np.unique(comp, return_inverse=True)[1]
        a, b = [], []
        for p in np.flatnonzero(side):
            other = (group != group[p]) & ~side & (np.minimum(n, n[p]) >= share * np.maximum(n, n[p]))
            # In this bucket only if no earlier band has the pair.
            other[other] = (keys[other] == keys[p]).argmax(1) == band[p]
            if not other.any():
                continue
            may, sure = sets.compare(p, share)
            # One sure link joins two groups; pairs that aren't sure are all proposed, but for those in one group by then.
            for t in np.flatnonzero(other & sure):
                if group[t] != group[p]:
                    a.append(rep[t])
                    b.append(rep[p])
                    group[group == group[t]] = group[p]
            for t in np.flatnonzero(other & may & ~sure & (group != group[p])):
                a.append(rep[t])
                b.append(rep[p])
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})
    return run


def _mixed(named: DataFrame) -> DataFrame:
    """bucket, rows, main (its largest component) and probes (rows outside that) of the buckets with several components."""
    sizes = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    by = sizes.groupBy("bucket").agg(F.max(F.struct("n", F.col("comp").alias("c"))).alias("top"), F.sum("n").alias("rows"), F.count("*").alias("comps"))
    return by.filter("comps > 1").select("bucket", "rows", F.col("top.c").alias("main"), (F.col("rows") - F.col("top.n")).alias("probes"))


def _finer(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of buckets cut into finer ones by CHOSEN groups of bins, a quarter of all; which quarter depends on the bucket."""
    step = BINS // ROWS // CHOSEN
    of = F.sequence(F.pmod(F.xxhash64(F.lit(3), "bucket"), F.lit(step)).cast("int"), F.lit(BINS // ROWS - 1), F.lit(step))
    cut = rows.join(keys, "rep").select("rep", "band", "comp", "bucket", "finer", F.explode(of).alias("j"))
    cut = cut.select("rep", "band", "comp", F.xxhash64("bucket", "j", F.get("finer", F.col("j"))).alias("bucket"))
    shared = cut.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return cut.join(shared, "bucket", "left_semi").select("bucket", "band", "rep", "comp")


def _left_over(buckets: DataFrame, reps: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch, report: dict) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose sketches may reach the threshold."""
    named = buckets.join(roots, buckets["rep"] == roots["node"], "left").select("bucket", "band", "rep", F.coalesce("root", "rep").alias("comp"))
    swept, keys = [], None
    for level in range(LEVELS + 1):
        mixed = scratch.keep(_mixed(named), f"mixed{level}")
        large = (F.col("rows") * F.col("probes") > MOST_PAIRS) & F.lit(level < LEVELS)
        inside = scratch.keep(named.join(mixed, "bucket"), f"inside{level}")
        swept.append(inside.filter(~large))
        rest = inside.filter(large).select("bucket", "band", "rep", "comp")
        if level == LEVELS or rest.isEmpty():
            break
        if keys is None:
            own = _sets(texts, reps, rest.select("rep").distinct(), size, "finer")
            # 64-bit numbers out of their bytes.
            numbers = F.transform(F.sequence(F.lit(0), F.lit(BINS // ROWS - 1)), lambda i: F.xxhash64(F.substring("shingles", i * 8 + 1, F.lit(8))))
            keys = scratch.keep(own.select("rep", numbers.alias("finer")), "finer_keys")
        named = scratch.keep(_finer(rest, keys), f"finer{level}")
    report["swept_pairs"] = sum(scratch.spark.read.parquet(f"{scratch.path}/mixed{k}").filter(F.lit(k == LEVELS) | (F.col("rows") * F.col("probes") <= MOST_PAIRS)).agg(F.coalesce(F.sum(F.col("rows") * F.col("probes")), F.lit(0))).first()[0] for k in range(len(swept)))
    inside = reduce(DataFrame.unionByName, swept).withColumns({"probe": F.col("comp") != F.col("main"), "h": F.abs(F.xxhash64("rep"))})
    # Probes and targets of a bucket are dealt into tiles of about TILE by TILE.
    cut = inside.withColumns({"np": F.ceil(F.col("probes") / TILE).cast("int"), "nt": F.ceil(F.col("rows") / TILE).cast("int")})
    probes = cut.filter("probe").select("bucket", "band", "rep", "comp", F.lit(True).alias("p_side"), (F.col("h") % F.col("np")).cast("int").alias("pt"), F.explode(F.sequence(F.lit(0), F.col("nt") - 1)).alias("tt"))
    targets = cut.select("bucket", "band", "rep", "comp", F.lit(False).alias("p_side"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("pt"), (F.col("h") % F.col("nt")).cast("int").alias("tt"))
    sketches = reps.select("rep", F.col("n_shingles").alias("n"), "keys").join(scratch.keep(_sets(texts, reps, inside.select("rep").distinct(), size, "sketch"), "sketches"), "rep")
    dealt = probes.unionByName(targets).join(scratch.keep(sketches, "tile_rows"), "rep")
    return dealt.groupBy("bucket", "pt", "tt").applyInArrow(_tile(percent), "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, report: dict) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        text = F.col(text_col).cast("string")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        signed = scratch.keep(texts.mapInArrow(_signed(size), _SIGNED), "signed")
        full = signed.filter("n_shingles > 0")
        # Equal sets have one hash: they are a class, which one of their texts stands for.
        one = full.groupBy("rep").agg(F.first(F.struct("doc_id", "text_hash", "n_shingles", "keys")).alias("one"))
        reps = scratch.keep(one.select("rep", "one.*"), "reps")
        rows = reps.select("rep", F.posexplode("keys").alias("band", "bucket"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        buckets = scratch.keep(rows.join(sizes, "bucket"), "buckets")
        degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
        centres = buckets.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", "rep")).alias("top")).select("bucket", F.col("top.rep").alias("centre"))
        centres = scratch.keep(centres, "centres")
        stars = buckets.join(centres, "bucket").filter("rep <> centre").select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
        links = _confirmed(stars, reps, texts, size, percent, scratch, "star_links")
        roots = components(links)
        more = _confirmed(_left_over(buckets, reps, roots, texts, size, percent, scratch, report), reps, texts, size, percent, scratch, "more_links")
        if not more.isEmpty():
            roots = components(links.union(more))
        least = full.groupBy("rep").agg(F.min("doc_id").alias("least"))
        named = scratch.keep(least.join(roots, least["rep"] == roots["node"], "left").select("rep", "least", F.coalesce("root", "rep").alias("root")), "named")
        groups = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("rep", "component_id")
        out = full.select("doc_id", "text_hash", "n_shingles", "rep").join(scratch.keep(groups, "groups"), "rep").select("doc_id", "text_hash", "n_shingles", "component_id")
        return checkpoint(out.union(signed.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None) -> DataFrame:
    """Each document's n_shingles and component_id, linking texts that share percent of the union of their shingles of size words.

    report: gets swept_pairs, the comparisons that step 4 may have made.
    """
    return _grouped(docs, size, percent, id_col, text_col, {} if report is None else report).drop("text_hash")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns. Of texts that share that id all stay."""
    away = _grouped(docs, size, percent, id_col, text_col, {}).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash")
    return without(docs, {"doc_id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(F.col(text_col).cast("string"))}, away)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are linked by four-word shingles."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, and all that can be reached: for small tables.
OP4_SQL = rf"""
WITH RECURSIVE own AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT row, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM own WHERE len(w) > 0)
), sizes AS (
    SELECT row, count(*) AS n FROM shingles GROUP BY row
), pairs AS (
    SELECT a.row AS a, b.row AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.row < b.row GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT row, row AS at FROM own UNION SELECT reached.row, ways.b FROM reached JOIN ways ON ways.a = reached.at
), roots AS (
    SELECT reached.row, min(own.doc_id) AS component_id FROM reached JOIN own ON own.row = reached.at GROUP BY reached.row
)
SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM own JOIN roots USING (row) LEFT JOIN sizes USING (row)
"""
