"""Packing token sequences: non-negative least squares over shallow length combinations, then greedy patterns.

A document of n tokens fills n // window whole sequences of its own; its last n % window tokens are its tail. How many
tails have which length is a histogram of at most window - 1 numbers, all that the plan needs:

1. Combinations of up to three tails that fill the window exactly are enumerated from the lengths at hand: all pairs,
   and for each longest part the BREADTH triples with the commonest other parts. Leaving out the rarer triples costs
   padding only, and little of it: step 3 packs what they would have held.
2. Repeat counts solve min |A x - histogram| with x >= 0 by coordinate descent, are rounded down and applied while
   enough tails are left.
3. The rest is packed greedily: the longest tail left, then again and again the longest that fits; the pattern is
   repeated as often as the histogram allows, so every pattern uses up a length and there are few patterns. A gap that
   no tail fills stays padding, unless the sequence's length is a power of two.

The plan is a table of slots (length, rank range, first sequence, offset), and a tail finds its slot by its rank among
the tails of its length. Ranks are exact and spread out: the tails of one length are dealt into ranges by id hash,
ranked in each, and shifted by the counts of earlier ranges. Only counts reach the driver.

Cases: a null or empty text is its end token alone; repeated rows are packed each; ties in length are ordered by a hash
of the id and then the id; very long texts fill several sequences; null ids are packed like others, and of rows that
share an id the pieces can't be told apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import Scratch, checkpoint
from lodeworks.llm.tokens import opened

WINDOW, END = 4096, 2
#: Ranges that the tails of one length are ranked in.
RANGES = 64
#: Combinations that the plan tries at most for one longest part.
BREADTH = 12


def combinations(hist: np.ndarray, window: int = WINDOW, breadth: int = BREADTH) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths with tails that add up to the window; for each longest part the breadth triples with the commonest second part."""
    have = np.flatnonzero(hist)
    out = []
    for a in have[::-1]:
        rest = window - a
        if 1 <= rest <= a and hist[rest]:
            out.append((int(a), int(rest)))
        second = have[(have <= a) & (have < rest) & (2 * have >= rest)]
        second = second[hist[rest - second] > 0]
        second = second[np.argsort(-np.minimum(hist[second], hist[rest - second]), kind="stable")[:breadth]]
        out += [(int(a), int(b), int(rest - b)) for b in second]
    return out


def repeats(combos: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - hist|, by coordinate descent; column c of A counts the lengths of combination c."""
    columns = []
    for c in combos:
        use = defaultdict(int)
        for length in c:
            use[length] += 1
        columns.append((np.array(list(use)), np.array(list(use.values()), float)))
    x, left = np.zeros(len(combos)), hist.astype(float)
    for _ in range(sweeps):
        moved = 0.0
        for i, (at, k) in enumerate(columns):
            step = max(-x[i], float(k @ left[at]) / float(k @ k))
            if step:
                x[i] += step
                left[at] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def patterns(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such) that use up the histogram; hist[n] tails have n tokens, n < window."""
    left = hist.astype(np.int64).copy()
    out = []
    combos = combinations(left, window)
    for c, x in zip(combos, repeats(combos, left), strict=True):
        use = np.bincount(c, minlength=window)
        at = np.flatnonzero(use)
        n = int(min(np.floor(x + 1e-9), (left[at] // use[at]).min()))
        if n > 0:
            left[at] -= n * use[at]
            out.append((c, n))
    have = np.flatnonzero(left)
    while len(have):
        room, own, spare = window, [], left.copy()
        while room:
            fit = have[: np.searchsorted(have, room, "right")]
            fit = fit[spare[fit] > 0]
            if not len(fit):
                break
            k = min(int(spare[fit[-1]]), room // int(fit[-1]))
            own += [int(fit[-1])] * k
            spare[fit[-1]] -= k
            room -= k * int(fit[-1])
        use = np.bincount(own, minlength=window)
        at = np.flatnonzero(use)
        n = int((left[at] // use[at]).min())
        left[at] -= n * use[at]
        out.append((tuple(own), n))
        have = np.flatnonzero(left)
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, np.ndarray], int]:
    """For each length its slots as rows (first rank, first sequence, offset), ordered by rank; and the number of sequences."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for own, n in plan:
        offset = 0
        for length in own:
            out[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}, sequence


_TOKENS = "doc_id bigint, doc_tokens bigint, crcs array<bigint>"


def _encoded(path: str, window: int, end: int):
    """Documents to their token counts and the CRC-32 of each whole window and of the tail."""
    def run(batches):
        encode = opened(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, counts, crcs = batch.column(0).slice(lo, 256), [], []
                for data in encode.many(batch.column(1).slice(lo, 256).to_pylist()):
                    data += tail
                    counts.append(len(data) // 4)
                    crcs.append([zlib.crc32(data[i : i + 4 * window]) for i in range(0, len(data), 4 * window)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])
    return run


def _placed(table: dict[int, np.ndarray]):
    """(…, tail, rank) to the tail's sequence and offset."""
    def run(batches):
        for batch in batches:
            tail, rank = batch.column("tail").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(tail), np.int64), np.zeros(len(tail), np.int64)
            order = np.argsort(tail, kind="stable")
            cuts = np.flatnonzero(np.diff(tail[order], prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                at = order[lo:hi]
                own = table[int(tail[at[0]])]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                sequence[at] = own[k, 1] + rank[at] - own[k, 0]
                offset[at] = own[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc_tokens", "crcs", "tail")), pa.array(sequence), pa.array(offset)], names=["doc_id", "doc_tokens", "crcs", "tail", "sequence", "at"])
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a tokenizers JSON file, read on the executors and the same on all of them.
    """
    with Scratch(docs.sparkSession) as scratch:
        made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded(tokenizer, window, end), _TOKENS)
        rows = scratch.keep(made, "tokens")
        rows = rows.withColumns({"tail": F.col("doc_tokens") % window, "part": F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)).cast("int")})
        # At most window * RANGES rows.
        counts = checkpoint(rows.filter("tail > 0").groupBy("tail", "part").agg(F.count("*").alias("n")))
        hist = np.zeros(window, np.int64)
        for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():
            hist[r["tail"]] = r["n"]
        table, tails = slots(patterns(hist, window))
        before = counts.select("tail", "part", (F.sum("n").over(W.partitionBy("tail").orderBy("part")) - F.col("n")).alias("before"))
        order = W.partitionBy("tail", "part").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id")
        ranked = rows.filter("tail > 0").withColumn("row", F.row_number().over(order) - 1).join(F.broadcast(before), ["tail", "part"])
        ends = ranked.select("doc_id", "doc_tokens", "crcs", "tail", (F.col("before") + F.col("row")).alias("rank")).mapInArrow(_placed(table), "doc_id bigint, doc_tokens bigint, crcs array<bigint>, tail bigint, sequence bigint, at bigint")
        pieces = ends.select("doc_id", (F.col("doc_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))
        # Whole windows are numbered after the tails: by partition, with the counts of earlier partitions before.
        whole = rows.filter(F.col("doc_tokens") >= window).select("doc_id", "doc_tokens", "crcs", "part", F.xxhash64(F.lit(11), "doc_id").alias("h"))
        whole = whole.withColumn("bin", F.pmod(F.col("h"), F.lit(4096)))
        many = whole.groupBy("bin").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("n"))
        many = many.select("bin", (F.sum("n").over(W.orderBy("bin")) - F.col("n")).alias("before"))
        own = W.partitionBy("bin").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        whole = whole.withColumn("k", F.floor(F.col("doc_tokens") / window)).withColumn("row", F.coalesce(F.sum("k").over(own), F.lit(0))).join(F.broadcast(many), "bin")
        full = whole.select("*", F.posexplode(F.slice("crcs", 1, F.col("k").cast("int"))).alias("i", "crc"))
        full = full.select("doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.lit(tails) + F.col("before") + F.col("row") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return checkpoint(pieces.unionByName(full))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
