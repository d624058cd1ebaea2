"""Values of components from documents and sources: which there are, what they become, and what is missing."""

from pyspark.sql import functions as F

from lodeworks.operators import reconciliation as rec

COMPONENTS = "component string, props array<string>, properties array<string>, methods array<string>, events array<string>, slots array<string>, lifecycle array<string>"
SYMBOLS = "id string, name string, path string, type string, signature string, visibility string, members array<string>"
VALUES = "component string, item_kind string, name string, source string, type string, default_value string, commit string, evidence string, ordinal long"


def test_source_values(spark, rows):
    components = spark.createDataFrame([("NcBox", ["p"], ["a", "b", "x"], ["m", "t", "n", "q"], ["change"], ["top"], ["init"]), ("NcBare", None, [], None, None, None, None)], COMPONENTS)
    symbols = spark.createDataFrame([("p", "BoxProps", "src/types.ts", None, "interface BoxProps", "package", ["a", "c"]), ("a", "size", "src/types.ts", "number", "size: number", "public", []), ("b", "open", "src/box.ts", None, "open", "public", None), ("c", "kind", "src/types.ts", "'x' | 'y'", "kind", None, []),
                                     ("x", "own", "src/box.ts", "string", "own", "private", []), ("m", "show", "src/box.ts", None, "show(): void", "public", []), ("t", "template", "src/box.ts", None, "template()", "public", []), ("n", "init", "src/box.ts", None, "init()", "public", []), ("q", "open", "src/box.ts", None, "open()", "public", [])], SYMBOLS)
    found = rec.source_values(components, symbols, F.lit("c1"))
    assert rows(found.select("component", "item_kind", "name", "source", "type", "evidence")) == sorted([
        ("NcBox", "attribute", "size", rec.TYPES, "number", "symbol:a"), ("NcBox", "attribute", "kind", rec.TYPES, "'x' | 'y'", "symbol:c"), ("NcBox", "attribute", "open", rec.CODE, "open", "symbol:b"),
        ("NcBox", "method", "show", rec.CODE, "show(): void", "symbol:m"), ("NcBox", "event", "change", rec.CODE, None, "symbol:NcBox"), ("NcBox", "slot", "top", rec.CODE, None, "symbol:NcBox")], key=repr)
    assert [r.name for r in found.filter("item_kind = 'attribute'").orderBy("_order").collect()] == ["size", "kind", "open"]


def test_documents_of_components(spark, rows):
    components = spark.createDataFrame([("NcButton",), ("NcGroup",), ("NcX",), ("Nc",)], "component string")
    pages = spark.createDataFrame([("d3", "Button Group", 3), ("d1", "nc-button", 1), ("d2", "NcButton", 2)], "document string, title string, ordinal int")
    assert rows(rec.documented_by(components, pages)) == [("NcButton", "d1"), ("NcGroup", "d3")]


def test_conflicts_and_coverage(spark, rows):
    values = spark.createDataFrame([
        ("A", "attribute", "max-size", rec.DOC, "Number", "1", "c1", "d1", 0), ("A", "attribute", "maxSize", rec.TYPES, "number", None, "c1", "s1", 5), ("A", "attribute", "kind", rec.DOC, "string", "x", "c1", "d2", 1), ("A", "attribute", "kind", rec.CODE, "'x'", "y", "c0", "s2", 6),
        ("A", "event", "nc-change", rec.DOC, None, None, "c1", "d3", 2), ("A", "event", "change", rec.CODE, None, None, "c1", "s3", 7), ("A", "method", "go", rec.CODE, "go()", None, "c1", "s4", 8), ("A", "slot", "top", rec.DOC, None, None, "c1", "d5", 3), ("B", "method", "run", "runtime-record", None, None, None, "r1", 0)], VALUES)
    found = {(r.component, r.item): r for r in rec.items(values, F.lit("c1")).collect()}
    assert {k: (r.status, r.confidence, r.sources, r.evidence) for k, r in found.items()} == {
        ("A", "maxsize"): ("verified", "high", [rec.DOC, rec.TYPES], ["d1", "s1"]), ("A", "kind"): ("conflict", "low", [rec.DOC, rec.CODE], ["d2", "s2"]), ("A", "change"): ("verified", "high", [rec.DOC, rec.CODE], ["d3", "s3"]),
        ("A", "go"): ("inferred", "medium", [rec.CODE], ["s4"]), ("A", "top"): ("documented", "medium", [rec.DOC], ["d5"]), ("B", "run"): ("verified", "high", ["runtime-record"], ["r1"])}
    out = rec.conflicts(values, F.lit("c1"), spark.createDataFrame([("A",)], "component string"))
    assert rows(out.select("name", "conflict", "severity", "source_a", "source_b", F.array_join("evidence", ","))) == sorted([
        ("kind", "type-mismatch", "error", rec.DOC, rec.CODE, "d2,s2"), ("kind", "default-mismatch", "warning", rec.DOC, rec.CODE, "d2,s2"), ("kind", "commit-mismatch", "error", rec.DOC, rec.DOC, "d2,d2"),
        ("go", "source-public-item-not-documented", "warning", rec.CODE, rec.DOC, "s4"), ("top", "documented-item-not-found-in-source", "error", rec.DOC, rec.CODE, "d5")], key=repr)
    table = {r.component: r for r in rec.coverage(values, out, spark.createDataFrame([("A",), ("A",)], "component string")).collect()}
    a, b = table["A"], table["B"]
    assert (a.n_attributes, a.n_events, a.n_methods, a.n_slots, a.n_examples, a.n_conflicts, a.missing, a.status) == (2, 1, 0, 1, 2, 5, ["methods"], "partial")
    assert (b.status, b.missing) == ("empty", ["attributes", "events", "methods", "slots", "examples"])
