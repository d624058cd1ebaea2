"""The queries and stages on odd tables: nulls, empty and very long texts, repeated rows, clashing columns, and no rows."""

import hashlib

import pytest

import corpus_pipeline
from lodeworks.llm import sharding
from lodeworks.llm.queries import QUERIES

LONG = "Some sentence of a very long text that goes on. " * 20_000
ROWS = [(1, "A short text of some words, repeated here and there.", "en", "web"), (1, "A short text of some words, repeated here and there.", "en", "web"), (2, None, None, None), (3, "", "en", "web"), (None, "no id has this text of ten words or even more", "en", None), (None, None, None, "web"),
        (5, LONG, "de", "web"), (6, " \n\t ", "", ""), (7, "x" * 100_000, "en", "web"), (8, "<|endoftext|> é 😀 \x00 licensed under the MIT License. All rights reserved.", "xx", "web"), (9, "A short text of some words, repeated here and there", "en", "web")]
PAGES = [(1, "http://h.example/a", "<article><p>text</p></article>"), (1, "http://h.example/a", "<article><p>text</p></article>"), (None, None, None), (2, "", ""), (3, "no url", "<p>" + LONG), (4, "http://h.example/b", "<" * 50_000)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    keep = request.param == "odd"
    docs = [(*r, len(r[1] or ""), "clash", 7) for r in ROWS] if keep else []
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, n_words int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, None), (7, 0, 1), (None, 1, 0)] if keep else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(*p, 1) for p in PAGES] if keep else [], "page_id bigint, url string, html string, text int").write.parquet(f"{at}/pages.parquet")
    items = [(1, "some sentence of a very long text that goes on", "x"), (1, "again the same id", "x"), (None, "no id has this text of ten words or even more", "x"), (2, None, None), (3, "", "x")]
    spark.createDataFrame(items if keep else [], "item_id bigint, text string, doc_id string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), keep


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_exact_dedup", "op4_near_dedup", "op5_packing", "op6_html_text", "op7_sharding", "op8_licenses", "op9_pieces", "op10_quality_model", "op11_fill_middle", "op12_importance", "op13_decontaminate"])
def test_odd_tables(spark, folder, name):
    at, keep = folder
    found = QUERIES[name](spark, at).collect()
    if not keep:
        assert found == []
    elif name == "op8_licenses":
        assert {r.doc_id for r in found} == {8}
    elif name == "op6_html_text":
        assert len(found) == len(PAGES) and {r.text for r in found if r.page_id == 1} == {"text"} and all(r.n_chars == len(r.text) for r in found)
    else:
        assert {r.doc_id for r in found} == {r[0] for r in ROWS}
        if name not in ("op5_packing", "op9_pieces"):
            assert len(found) == len(ROWS)
        by = {r[0]: [x for x in found if x.doc_id == r[0]] for r in ROWS}
        if name == "op9_pieces":
            assert all(r.round_trip for r in found)
        if name == "op1_quality_rules":
            assert {r.n_words for r in by[2] + by[3] + by[6]} == {0} and by[5][0].n_words == 200_000 and not any(r.kept for r in by[2])
        if name == "op2_exact_dedup":
            assert [r.kept for r in by[1]] == [True, True] and {r.group_size for r in by[3]} == {3} and by[5][0].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
        if name == "op4_near_dedup":
            assert {(r.doc_id, r.component_id) for r in by[1] + by[2] + by[3]} == {(1, 1), (2, 2), (3, 3)} and {r.n_shingles for r in by[2] + by[3] + by[6]} == {0} and by[5][0].n_shingles == 10
        if name == "op11_fill_middle":
            assert all(r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in ROWS if i == 5 or i == 7 for r in by[i]) and by[2][0].form == "plain"
        if name == "op12_importance":
            assert by[5][0].n_features == 2 * 200_000 - 1 and {r.weight for r in by[2] + by[3] + by[6]} == {0} and len(by[1]) == 2
        if name == "op13_decontaminate":
            assert by[5][0].n_hit == 200_000 and by[5][0].n_items == 1 and {r.n_hit for r in by[2] + by[3] + by[9]} == {0} and {r.n_items for r in by[None]} == {0, 1}


def test_odd_pages_in_archives(spark, folder):
    at, keep = folder
    found = QUERIES["op3_warc_store"](spark, at).collect()
    assert len(found) == (len(PAGES) if keep else 0)
    if keep:
        sizes = {p[0]: len((p[2] or "").encode()) for p in PAGES}
        assert all(r.payload_bytes == sizes[r.page_id] and r.payload_digest == hashlib.sha256(next(p[2] or "" for p in PAGES if p[0] == r.page_id).encode()).hexdigest() for r in found)


def test_stages_on_odd_tables(spark, folder, tmp_path):
    at, keep = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if k < 4:
            assert out.columns == names
        if k > 0:  # the model of four labels may reject all
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
    if not keep:
        assert docs.count() == 0


def test_ranks_equal_those_of_sorting(spark):
    """Fractional ranks, shards and slots against the same by sorting lists."""
    rows = [(i, s) for i, s in enumerate(["big"] * 150 + ["a"] * 40 + [None] * 9 + ["b"])]
    found = {r.doc_id: r for r in sharding.interleave(spark.createDataFrame(rows, "doc_id bigint, source string").repartition(5), shards=7, per_part=10).collect()}
    key = lambda i: hashlib.md5(f"20:{i}".encode()).hexdigest()
    by = {}
    for i, s in rows:
        by.setdefault(s, []).append(i)
    at = {i: ((2 * k + 1) / (2 * len(own)), s or "", key(i), i) for s, own in by.items() for k, i in enumerate(sorted(own, key=lambda i: (key(i), i)))}
    order = sorted(at, key=lambda i: (at[i][0], rows[i][1] is not None, *at[i][1:]))
    for place, i in enumerate(order):
        shard = place * 7 // len(rows)
        assert found[i].fraction == pytest.approx(at[i][0]) and found[i].shard == shard and found[i].slot == place - -(-shard * len(rows) // 7)
