"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodeworks.llm import exact_dedup, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnopqrst") + str(r.randint(0, 40)) for _ in range(n)]


def edited(r, own, n):
    own = list(own)
    for _ in range(n):
        own[r.randrange(len(own))] = "x" + str(r.randint(0, 9999))
    return own


@pytest.fixture(scope="module")
def texts():
    """Chains of copies, copies with few edits, short texts, repeated rows, and odd ones."""
    r = random.Random(5)
    out = [None, "", " \t\n", "one", "ONE", "two words", "two  words\n", "three words here", "word " * 400]
    for size in (8, 30, 120, 900, 2500):
        base = words(r, size)
        for k in range(14):
            out.append(" ".join(base))
            base = edited(r, base, max(1, size * (k % 4) // 60))
    out += [" ".join(words(r, r.randint(5, 200))) for _ in range(60)]
    out += [out[20], out[20].upper(), out[40]]
    r.shuffle(out)
    return list(enumerate(out))


def shingles(text, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_groups(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_equal_brute_force(spark, texts, size):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in texts], "doc_id bigint, text string, rep string").repartition(7)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, size=size).collect()}
    assert found == brute_groups(texts, size)


def test_leftovers_are_found_in_small_tiles(spark, texts, monkeypatch):
    """With few hashes in a sketch, small tiles and no star links the sweep alone must find all links."""
    monkeypatch.setattr(near_dedup, "TILE", 3)
    monkeypatch.setattr(near_dedup, "SKETCH", 64)
    kept = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, reps, docs, size, percent, scratch, name: kept(pairs.limit(0) if name == "star_links" else pairs, reps, docs, size, percent, scratch, name))
    rows = texts[:90]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, size=4).collect()}
    assert found == brute_groups(rows, 4)


def test_large_buckets_are_cut_into_finer_ones(spark, texts, monkeypatch):
    """The same with a bound on comparisons that nearly all mixed buckets exceed."""
    monkeypatch.setattr(near_dedup, "MOST_PAIRS", 2)
    kept = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, reps, docs, size, percent, scratch, name: kept(pairs.limit(0) if name == "star_links" else pairs, reps, docs, size, percent, scratch, name))
    rows = texts[:90]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs, size=4).collect()}
    assert found == brute_groups(rows, 4)


def test_a_bucket_of_many_singletons_is_not_swept_whole(spark, monkeypatch):
    """20,000 unlike texts that all share one more bucket, as by a common passage, and some near copies among them."""
    r = random.Random(8)
    rows = [(i, " ".join(words(r, 24))) for i in range(20_000)]
    copied = r.sample(range(20_000), 40)
    rows += [(20_000 + k, rows[i][1] + " more") for k, i in enumerate(copied)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    left_over = near_dedup._left_over

    def with_one_more(buckets, reps, *rest):
        common = reps.selectExpr("5L AS bucket", "0 AS band", "rep")
        return left_over(buckets.select("bucket", "band", "rep").unionByName(common), reps, *rest)

    monkeypatch.setattr(near_dedup, "_left_over", with_one_more)
    report = {}
    found = {x.doc_id: x.component_id for x in near_dedup.near_groups(docs, size=4, report=report).collect()}
    assert found == {**{i: i for i in range(20_000)}, **{20_000 + k: i for k, i in enumerate(copied)}}
    assert report["swept_pairs"] < 20_000 * 20_000 / 1000


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_groups(docs).collect()) == [(1, 1)] * 3 + [(2, 1)]
    # Two texts with one id, null ids, a near copy of one of them, and a clashing column.
    long = "one two three four five six seven eight nine ten eleven twelve"
    odd = spark.createDataFrame([(7, long, 1), (7, "something else that is not like it", 2), (9, long + " x", 3), (None, long, 4), (None, None, 5), (None, "a text of its own here", 6)], "doc_id bigint, text string, rep int")
    assert sorted(((r.doc_id, r.component_id) for r in near_dedup.near_groups(odd).collect()), key=str) == sorted([(7, 7), (7, 7), (9, 7), (None, 7), (None, None), (None, None)], key=str)
    assert sorted(r.rep for r in near_dedup.keep_one(odd).collect()) == [1, 2, 5, 6]
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    assert near_dedup.keep_one(docs.limit(0)).columns == docs.columns


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(r.randint(400, 900), r.randint(400, 900)) for _ in range(300)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint"))
    linked = {i for a, b in links if a != b for i in (a, b)}
    assert {x.node: x.root for x in out.collect()} == {i: find(i) for i in linked}


def test_densification_gives_equal_sets_equal_values():
    small = near_dedup.shingle_set("a b c d e f", 4, near_dedup._Hashes())
    assert len(small) == 3 and len(set(near_dedup.signature(small).tolist())) <= 3
    assert (near_dedup.band_keys(near_dedup.signature(small)) == near_dedup.band_keys(near_dedup.signature(small.copy()))).all()


def test_sketches_compare_whole_sets_exactly():
    r = np.random.default_rng(0)
    sets = [np.sort(r.choice(400, r.integers(5, 200), replace=False)).astype(np.uint32) for _ in range(30)]
    s = near_dedup.Sketches(sets, np.array([len(x) for x in sets]))
    for i, x in enumerate(sets):
        may, sure = s.compare(i, 0.5)
        exact = [2 * len(set(x) & set(y)) >= len(set(x) | set(y)) for y in sets]
        assert may.tolist() == sure.tolist() == exact


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_exact_dedup_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, digest string")
    out = exact_dedup.exact_dedup(docs)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in out.collect()) == brute_exact(texts)
    assert exact_dedup.keep_one(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def verdicts(df):
    return sorted((r.doc_id, r.keep_id, r.kept) for r in df.collect())


def test_digest_index_across_batches(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    with exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4) as index:
        first = index.dedup(make([(1, "a"), (2, "a"), (3, "b")]))
        assert verdicts(first) == [(1, 2, False), (2, 2, True), (3, 3, True)]
    with exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index") as again:
        assert again.buckets == 4
        second = again.dedup(make([(9, "a"), (10, None), (11, "")]))
        assert verdicts(second) == [(9, 2, False), (10, 11, False), (11, 11, True)]
        assert again.rows().count() == 3
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3)


def test_a_batch_that_is_given_again_gets_the_same_verdicts(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    want = [(1, 2, False), (2, 2, True), (3, 3, True)]
    with exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2) as index:
        # Lost after its digests were written, before they were published.
        publish = exact_dedup.DigestIndex._publish
        monkeypatch.setattr(exact_dedup.DigestIndex, "_publish", lambda self, runs: publish(self, runs) if len(runs) == 1 else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.dedup(docs, batch="x")
    monkeypatch.undo()
    with exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index") as index:
        assert index.rows().count() == 0
        assert verdicts(index.dedup(docs, batch="x")) == want
        # Lost after it was published: the same batch again, and another one with the same texts.
        assert verdicts(index.dedup(docs, batch="x")) == want
        assert index.rows().count() == 2
        assert [r[2] for r in verdicts(index.dedup(docs, batch="y"))] == [False] * 3


def test_appends_are_compacted_and_scans_need_no_sort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_RUNS", 3)
    with exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=3) as index:
        for k in range(5):
            docs = spark.createDataFrame([(100 * k + i, f"text {(k + 1) * i}") for i in range(40)], "doc_id bigint, text string")
            found = index.dedup(docs, batch=str(k))
            seen = {f"text {(j + 1) * i}" for j in range(k) for i in range(40)}
            assert {r.doc_id for r in found.collect() if r.kept} == {100 * k + i for i in range(40) if f"text {(k + 1) * i}" not in seen}
        assert len(index.runs) <= 4
        index.compact()
        assert len(index.runs) == 1 and index.rows().count() == index.rows().select("digest").distinct().count()
        with index._sorted_scans():
            plan = index.unknown(exact_dedup.checkpoint(exact_dedup.digests(docs).select("digest")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Sort [") == 1 and "SortMergeJoin" in plan


def test_null_ids_and_repeated_rows_keep_each_text(spark):
    rows = [(7, "a", 1), (7, "b", 2), (9, "b", 3), (None, "c", 4), (None, "c", 5), (None, "a", 6), (8, "d", 7), (8, "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(7, "a"), (9, "b"), (None, "c"), (8, "d")], key=str)
    assert all(r.kept is not None for r in exact_dedup.exact_dedup(docs).collect())
