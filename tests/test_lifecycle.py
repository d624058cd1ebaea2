"""Learning and task lifecycles on literal rows."""

import json

from pyspark.sql import functions as F

from lodeworks.operators import lifecycle as L

C = F.col


def test_topics(spark):
    seeds = spark.createDataFrame([("t1", "Button", ["NcButton", "size"], 5), ("t2", "None", ["nothing"], 9)], "id string, title string, names array<string>, priority int")
    symbols = spark.createDataFrame([("s1", "NcButton"), ("s2", "size"), ("s3", "other")], "id string, name string")
    parts = spark.createDataFrame([("c1", "NcButton")], "id string, name string")
    units = spark.createDataFrame([("Button", "x"), ("None", "y")], "title string, commit string")
    assert [(r.id, r.symbol_ids, r.component_ids, r.covered) for r in L.topics(seeds, symbols, parts, units, "x").collect()] == [("t2", [], [], False), ("t1", ["s1", "s2"], ["c1"], True)]


def test_bundles_and_claims(spark, rows):
    s = spark.createDataFrame([("b", 1, "x" * 40), ("b", 2, "x" * 30), ("b", 3, "x" * 99)], "g string, o int, text string")
    assert rows(L.bundle(s, "g", [C("o")], 20).select("o", "used")) == [(1, 10), (2, 18)]
    claims = spark.createDataFrame([("u", "1", "verified", ["e1"]), ("u", "2", "documented", []), ("v", "1", "inferred", ["e9"]), ("v", "1", "documented", None)], "unit_id string, id string, status string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1",)], "id string")
    assert rows(L.claim_faults(claims, evidence)) == [("u", "no-evidence", 1), ("v", "no-evidence", 1), ("v", "repeated-id", 1), ("v", "unknown-evidence", 1)]
    approvals = spark.createDataFrame([("u", "1"), ("u", "2"), ("v", "1")], "unit_id string, claim_id string")
    assert rows(L.publishable(claims, approvals)) == [("u", True), ("v", False)]
    assert rows(L.may_carry_forward(claims)) == [("u", False), ("v", True)]


def test_revisions(spark, rows):
    units = spark.createDataFrame([("a", 1, "published", "x"), ("b", 1, "published", "x"), ("b", 2, "published", "y")], "id string, revision int, status string, commit string")
    changes = spark.createDataFrame([("a", "carry_forward", "z"), ("b", "retire", "z")], "id string, action string, commit string")
    out = L.revised(units, changes)
    assert out.count() == 5
    assert rows(L.current(out)) == [("a", 2, "published", "z"), ("b", 3, "retired", "y")]
    impacts = spark.createDataFrame([("a", "partially_stale"), ("b", "stale"), ("c", "current")], "unit_id string, state string")
    assert rows(L.refresh_plan(impacts).select("unit_id", "priority")) == [("a", 99), ("b", 100)]


def test_coverage_and_families(spark, rows):
    units = spark.createDataFrame([(["s1"], ["c1", "zz"]), (["s1", "s2"], None)], "symbols array<string>, components array<string>")
    dims = {"symbols": (spark.createDataFrame([(f"s{i}",) for i in range(4)], "id string"), "id"), "components": (spark.createDataFrame([], "id string"), "id")}
    assert rows(L.coverage(units, dims)) == [("components", 0, 0, 0.0), ("symbols", 2, 4, 0.5)]
    families = spark.createDataFrame([("f", ["a", "b"])], "family_id string, members array<string>")
    reviews = spark.createDataFrame([("f", ["a"]), ("f", ["a", "q"]), ("g", ["a"])], "family_id string, included array<string>")
    assert rows(L.bad_families(reviews, families).select("family_id", "strangers")) == [("f", ["q"]), ("g", ["a"])]


def test_comparing_and_closing(spark, rows):
    make = lambda xs: spark.createDataFrame(xs, "fingerprint string, blocking boolean")
    assert rows(L.comparison(make([("a", True), ("b", True)]), make([("b", True)]))) == [(0, 1, 1, 0, "improved")]
    assert rows(L.comparison(make([("a", False)]), make([("c", True)]))) == [(1, 1, 0, 1, "regressed")]
    assert rows(L.comparison(make([]), make([]))) == [(0, 0, 0, 0, "unchanged")]
    criteria = spark.createDataFrame([("t", "1", True, True, "passed"), ("t", "2", True, False, "manual_required"), ("u", "1", True, True, "failed")], "task_id string, id string, required boolean, automated boolean, status string")
    assert rows(L.closable(criteria, spark.createDataFrame([("t", "2")], "task_id string, id string"))) == [("t", True), ("u", False)]
    assert rows(L.closable(criteria, spark.createDataFrame([], "task_id string, id string"))) == [("t", False), ("u", False)]


def test_versions_and_reports(spark, rows):
    c = spark.createDataFrame([("c1", "x", "h"), ("c2", "y", "k")], "id string, commit string, root_hash string")
    s = spark.createDataFrame([("s1", "x", "h"), ("s2", "y", "h")], "id string, commit string, catalog_hash string")
    assert rows(L.version_binding(c, s)) == [("x", "c1", "s1", True), ("y", "c2", "s2", False)]
    table = spark.createDataFrame([(2, "a|b"), (1, None)], "n int, text string")
    assert L.markdown_table(table, ["n"]).first()[0] == "| n | text |\n| --- | --- |\n| 1 | - |\n| 2 | a\\|b |"


def test_draft_faults(spark, rows):
    def draft(claims, bundle="b"):
        return json.dumps({"sourceBundleId": bundle, "claims": claims})

    good = {"id": "1", "status": "verified", "evidenceIds": ["E1"]}
    texts = {
        "good": draft([good]), "no claims": draft([]), "large": draft([good]) + " " * 81920, "broken": "{", "null": None, "empty": "", "path": draft([good | {"text": "see C:\\Users\\me\\x"}]),
        "list": draft("none"), "other": draft([good], "c"), "foreign": draft([good | {"evidenceIds": ["E7"]}]), "many": draft([good, good, {"id": "2", "status": "inferred"}, {"id": "3", "status": "verified", "evidenceIds": ["x", "y", None]}]),
    }
    drafts = spark.createDataFrame([(k, "b", x) for k, x in texts.items()] + [("no bundle", None, draft([good], None))], "draft_id string, bundle_id string, raw string")
    evidence = spark.createDataFrame([("b", "E1"), ("b", "x"), ("c", "E7")], "bundle_id string, id string")
    want = [("broken", "INVALID_JSON", 1), ("empty", "INVALID_JSON", 1), ("null", "INVALID_JSON", 1), ("large", "OUTPUT_TOO_LARGE", 1), ("path", "ABSOLUTE_PATH", 1), ("list", "SCHEMA_INVALID", 1), ("other", "BUNDLE_MISMATCH", 1), ("no bundle", "BUNDLE_MISMATCH", 1),
            ("foreign", "UNKNOWN_EVIDENCE", 1), ("many", "REPEATED_CLAIM", 1), ("many", "NO_EVIDENCE", 1), ("many", "UNKNOWN_EVIDENCE", 2), ("many", "UNCHECKED", 1)]
    assert rows(L.draft_faults(drafts, evidence)) == sorted(want, key=repr)
    assert rows(L.draft_faults(drafts.limit(0), evidence)) == []
