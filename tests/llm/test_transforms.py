"""Fill-in-middle cuts, importance resampling and decontamination against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import decontaminate, fill_middle, importance

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " ", "x", "one two", "with <P> inside", "<S>", "<M><", "é😀 wide ünï", "ends in <", "<" * 9, "a\nb\n\nc", "tab\tand\x0bmore ", "P> S> M>", "word " * 300, "\x00nul\x00", "漢字かな"]


def words(text):
    return WORD.findall((text or "").translate(LOW))


# ---- fill in middle


def expected(text, i):
    text, n = text or "", len(text or "")
    key = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_cuts_equal_brute_force_and_are_undone(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(None, "no id at all"), (7, "again"), (7, "again"), (-3, "below")]
    out = fill_middle.transform(spark.createDataFrame(rows, DOCS))
    out = out.withColumn("back", fill_middle.restored(out["output"], out["form"]))
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=repr)
    assert found == sorted(((i, *expected(t, i)) for i, t in rows), key=repr)
    assert sorted(r.back for r in out.collect()) == sorted(t or "" for _, t in rows)
    assert {f[2] for f in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, pieces", [("word", r"[ \t-\r]+|[^ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")])
def test_units_end_where_classes_change(unit, pieces):
    for text in TEXTS:
        codes = np.array([ord(c) for c in text or ""], np.uint32)
        ends = [m.end() for m in re.finditer(pieces, text or "")]
        assert fill_middle.boundaries(codes, unit).tolist() == [0, *ends]


def test_pieces_of_words_are_cut_at_words():
    text = "some words  of a text\nwith lines"
    for k in range(60):
        n, form, prefix, middle, out = fill_middle.cut(text, hashlib.sha256(f"1:{k}".encode()).hexdigest(), "word")
        if form != "plain":
            ends = {0, *(m.end() for m in re.finditer(r"\s+|\S+", text))}
            assert prefix in ends and prefix + middle in ends and n == len(text)


# ---- importance


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def weights(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t))
    t = Counter(bucket(f) for x in target for f in features(x))
    n, m = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in map(bucket, features(text))]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(n=300, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü漢") for _ in range(r.randint(1, 6))) for _ in range(400)]
    return [(i, " ".join(r.choice(vocabulary).title() for _ in range(r.randint(0, 60)))) for i in range(n)], [" ".join(r.choices(vocabulary[:40], k=30)) for _ in range(9)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_draw_equals_brute_force(spark, partitions):
    docs, target = corpus()
    docs += [(900, None), (901, ""), (902, "!!"), (None, "x " * 40), (903, docs[3][1]), (5, "y " * 25)]
    found = importance.resample(spark.createDataFrame(docs, DOCS).repartition(partitions), spark.createDataFrame([(k, t) for k, t in enumerate(target)], ITEMS))
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found.collect()), key=repr) == weights(docs, target)


def test_ties_go_to_the_smaller_id(spark):
    """Equal texts and, by a constant seed for few ids, equal scores: the order of equal scores is that of ids."""
    docs = [(i % 4, "same words here " * 10) for i in range(40)]
    found = importance.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "same words")], ITEMS), percent=50).collect()
    drawn = sorted((r.rank, -r.score, r.doc_id) for r in found if r.rank)
    assert [d[0] for d in drawn] == list(range(1, 21)) and [d[1:] for d in drawn] == sorted(d[1:] for d in drawn)


def test_empty_tables_of_either_side(spark):
    docs, target = corpus(30)
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(docs, DOCS)
    assert importance.resample(none, spark.createDataFrame([(1, target[0])], ITEMS)).collect() == []
    found = importance.resample(some, spark.createDataFrame([], ITEMS)).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found), key=repr) == weights(docs, [])


@pytest.mark.parametrize("size", [1, 3, 10, 64, 1000])
def test_blocks_of_long_texts_lose_no_feature(size):
    counter = importance.Counter(10_000)
    for text in [*(t or "" for t in TEXTS), "Ab, cd " * 40, "x" * 500, "... " * 30 + "end", "first" + " " * 200 + "last", corpus(4)[0][2][1]]:
        found = Counter()
        n = 0
        for own, carried in importance.blocks(text, size):
            for _, k, buckets, times in counter.count([own], [carried]):
                n += k
                found.update(dict(zip(buckets.tolist(), times.tolist(), strict=True)))
        assert n == len(words(text)) and found == Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text))


# ---- decontamination


def verdicts(docs, items, size=10):
    known = []
    for item, text in items:
        w = words(text)
        if w:
            n = min(size, len(w))
            known += [("" if item is None else str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    out = []
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for item, part in known:
            for k in range(len(w) - len(part) + 1):
                if tuple(w[k : k + len(part)]) == part:
                    hit.update(range(k, k + len(part)))
                    met.add(item)
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr), known


def leaky(seed=11):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ü", "漢字"]
    some = lambda n: " ".join(r.choices(vocabulary, k=n))
    shared = some(14)
    items = [(k, f"{some(r.randint(8, 16))}, {shared if k % 2 else ''} {some(5)}") for k in range(12)]
    items += [(12, "W1 w2"), (13, "w7 W8 w9"), (14, None), (15, " ?! "), (None, some(11)), (2, some(12)), (10, shared)]
    docs = []
    for i in range(120):
        parts = [some(r.randint(0, 25)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(r.randint(0, 3), shared.upper() if i % 2 else shared.replace(" ", "... "))
        if i % 5 == 0:
            parts.insert(r.randint(0, 3), items[i % 12][1])
        docs.append((i, "\n".join(parts)))
    return docs + [(None, None), (500, ""), (501, shared), (501, shared), (502, f"{shared} " * 50), (503, items[3][1][:30])], items


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 40])
def test_verdicts_equal_brute_force(spark, most):
    docs, items = leaky()
    found = decontaminate.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most=most).collect()
    want, _ = verdicts(docs, items)
    assert sorted((tuple(r) for r in found), key=repr) == want
    assert any(w[3] > 3 for w in want) and any(not w[5] for w in want)


def test_spans_and_documents_are_removed(spark):
    docs, items = leaky()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, row int, at string")
    bench = spark.createDataFrame(items, ITEMS)
    want, known = verdicts(docs, items)
    out = decontaminate.clean(frame, bench)
    assert out.columns == frame.columns and out.count() == len(docs)
    texts = {r.doc_id: r.text for r in out.collect()}
    for i, text in docs:
        w, hit = words(text), set()
        for _, part in known:
            for k in range(len(w) - len(part) + 1):
                if tuple(w[k : k + len(part)]) == part:
                    hit.update(range(k, k + len(part)))
        if not hit:
            assert texts[i] == text
        else:
            original = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
            assert re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", texts[i]) == [x for k, x in enumerate(original) if k not in hit]
    left = decontaminate.clean(frame, bench, "documents")
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r[0] for r in want if not r[5]), key=repr)


def test_empty_benchmark_and_no_documents(spark):
    docs, items = leaky()
    found = decontaminate.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect()
    assert len(found) == len(docs) and not any(r.contaminated for r in found)
    assert decontaminate.judge(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
