"""The corpus pipeline on the small tables, stage by stage, and the registration of its queries."""

from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodeworks.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
            assert docs.select("doc_id").distinct().count() == docs.count() <= kept[-1]
            kept.append(docs.count())
    texts = defaultdict(int)
    for r in spark.read.parquet(f"{tmp_path}/2").collect():
        texts[r.text or ""] += 1
    assert max(texts.values()) == 1
    last = docs.collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    whole = sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted((r.doc_id, r.start, r.length) for r in last)


def test_clean_documents_are_kept(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(labels, "doc_id").count()
    assert corpus_pipeline.classify(spark, docs, SF).join(labels, "doc_id").count() >= 0.98 * good


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF).select(*columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_ten_operators_and_the_pipeline_are_registered():
    known = entry.queries()
    assert "pipeline" in known and all(sum(n.startswith(f"op{k}_") for n in known) == 1 for k in range(1, 11))
