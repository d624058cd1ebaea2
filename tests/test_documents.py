"""Rules over JSON documents, collections of tables, and folders with faulty files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeworks.sources import documents, snapshots
from lodeworks.sources import validation as V

SCHEMA = {
    "type": "object", "required": ["id", "items"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2, "maxLength": 5}, "count": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "ratio": {"type": "number"}, "mode": {"enum": ["a", "b", True, None]},
        "items": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/item"}},
    },
    "$defs": {"item": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "on": {"type": "boolean"}}}},
}


def by_hand(doc, schema, path="$", place="$"):
    if "$ref" in schema:
        schema = SCHEMA["$defs"][schema["$ref"].rsplit("/", 1)[1]]
    kind = "null" if doc is None else {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(doc)]
    out = []
    text = "null" if doc is None else json.dumps(doc, separators=(",", ":")) if isinstance(doc, (bool, dict, list)) else str(doc)
    if "type" in schema:
        want = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if kind not in want and not (kind == "integer" and "number" in want):
            out.append((f"{path} type", place, kind))
    if "enum" in schema and doc not in schema["enum"]:
        out.append((f"{path} enum", place, text))
    if kind == "string" and "pattern" in schema and not re.search(schema["pattern"], doc):
        out.append((f"{path} pattern", place, doc))
    for name, size, least in (("minLength", len(doc) if kind == "string" else None, True), ("maxLength", len(doc) if kind == "string" else None, False), ("minItems", len(doc) if kind == "array" else None, True), ("maxItems", len(doc) if kind == "array" else None, False), ("minimum", doc if kind in ("integer", "number") else None, True), ("maximum", doc if kind in ("integer", "number") else None, False)):
        if name in schema and size is not None and (size < schema[name] if least else size > schema[name]):
            out.append((f"{path} {name}", place, str(size)))
    if kind == "object":
        for name, lost in (("required", sorted(set(schema.get("required", [])) - set(doc))), ("additional", sorted(set(doc) - set(schema.get("properties", {}))) if schema.get("additionalProperties") is False else [])):
            if lost:
                out.append((f"{path} {name}", place, ",".join(lost)))
        for k, inner in schema.get("properties", {}).items():
            if k in doc:
                out += by_hand(doc[k], inner, f"{path}.{k}", f"{place}.{k}")
    if kind == "array" and "items" in schema:
        for n, x in enumerate(doc):
            out += by_hand(x, schema["items"], f"{path}[*]", f"{place}[{n}]")
    return out


def test_schemas_equal_a_walk_by_hand(spark, rows):
    r = random.Random(8)
    value = lambda: r.choice(["abc", "A", "toolong", "", 5, 0, 12, 2.5, True, None, "a", [], ["x"], {"name": "n"}])
    docs = []
    for _ in range(150):
        own = {k: value() for k in ("id", "count", "ratio", "mode", "more") if r.random() < 0.6}
        if r.random() < 0.8:
            own["items"] = r.choice([value(), [r.choice([{"name": "n"}, {"name": 3, "on": True}, {"on": "no"}, 7, {}]) for _ in range(r.randint(0, 4))]])
        docs.append(own)
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "{broken"), (901, None), (902, '"text"'), (903, "[]")], "key int, doc string")
    found = V.faults(frame, "key", "doc", V.from_schema(SCHEMA))
    want = [(i, *x) for i, d in enumerate([*docs]) for x in by_hand(d, SCHEMA)] + [(900, "$ json", "$", "invalid"), (901, "$ json", "$", "invalid"), (902, "$ type", "$", "string"), (903, "$ type", "$", "array")]
    assert rows(found) == sorted(want, key=repr) and len({w[1] for w in want}) > 12


def test_documents_are_parsed_once_and_nodes_asked_alone(spark, rows):
    docs = spark.createDataFrame([(1, '{"a": [{"b": null, "c d": [1, "x"]}, 5, {"b": {"b": 2}}], "z": 1}'), (2, "{broken"), (3, '{"a": {"b": 1}}'), (4, None)], "key int, doc string")
    found = V.nodes(docs, "key", "doc", {"$.a[*].b", "$.a[*].c d[*]"})
    assert rows(found.select("key", "path", "place", "kind")) == sorted([(1, "$.a[*].b", "$.a[0].b", "null"), (1, "$.a[*].b", "$.a[2].b", "object"), (1, "$.a[*].c d[*]", "$.a[0].c d[0]", "integer"), (1, "$.a[*].c d[*]", "$.a[0].c d[1]", "string"), (2, "$", "$", "invalid"), (4, "$", "$", "invalid")], key=repr)
    frame = spark.range(3).selectExpr("id as key", "format_string('{\"a\": [%s]}', id) as doc")
    plan = V.nodes(frame, "key", "doc", {"$.a", "$.a[*]"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parseJson") == 1


def test_rules_between_places_and_cycles(spark, rows):
    plan = lambda *steps: json.dumps({"steps": [{"id": i, "cwd": c, "dependencies": d} for i, c, d in steps]})
    docs = spark.createDataFrame([(1, plan(("a", ".", []), ("b", "x/y", ["a"]))), (2, plan(("a", "/abs", ["c"]), ("b", "C:/x", ["a"]), ("c", "a/../..", ["b"]), ("d", ".", ["c"]))), (3, plan(("A b", ".", []), ("a", ".", ["zz", "a"]), ("a", ".", []))), (4, "{}")], "key int, doc string")
    assert rows(V.faults(docs, "key", "doc", V.PLAN)) == sorted([(2, "$.steps[*].cwd pattern", "$.steps[0].cwd", "/abs"), (2, "$.steps[*].cwd pattern", "$.steps[1].cwd", "C:/x"), (2, "$.steps[*].cwd pattern", "$.steps[2].cwd", "a/../.."),
                                                              (3, "$.steps[*].id pattern", "$.steps[0].id", "A b"), (3, "$.steps[*].id unique", "$.steps[1].id", "a"), (3, "$.steps[*].dependencies[*] within", "$.steps[1].dependencies[0]", "zz")], key=repr)
    assert rows(V.on_cycles(V.plan_edges(docs, "key", "doc"))) == [(2, "a"), (2, "b"), (2, "c"), (3, "a")]
    policy = spark.createDataFrame([(1, '{"allowedPaths": ["src/**", "a"], "deniedPaths": ["a", "b"]}'), (2, '{"allowedPaths": ["x"]}')], "key int, doc string")
    assert rows(V.faults(policy, "key", "doc", V.POLICY)) == [(1, "$.allowedPaths[*] apart", "$.allowedPaths[1]", "a")]


def test_collections_are_whole_or_absent(spark, tmp_path, rows):
    store = snapshots.CollectionStore(spark, f"file://{tmp_path}/docs", {"raw": "path", "parsed": "id"})
    raw = spark.createDataFrame([("a", "<p>x"), ("b", "y")], "path string, body string")
    parsed = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    assert store.current() is None and store.write({"raw": raw, "parsed": parsed}, "one") == "written"
    assert store.write({"raw": raw.orderBy(F.desc("path")), "parsed": parsed}, "one") == "unchanged"
    with pytest.raises(FileExistsError):
        store.write({"raw": raw, "parsed": parsed.limit(1)}, "one")
    with pytest.raises(ValueError):
        store.write({"raw": raw}, "two")
    bad = parsed.withColumn("text", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        store.write({"raw": raw.limit(1), "parsed": bad}, "two")
    assert store.current() == "one" and store.read("raw").count() == 2 and set(store.manifest()) == {"raw", "parsed"} and store.valid("one")
    assert store.write({"raw": raw.limit(1), "parsed": parsed}, "two") == "written"
    assert store.current() == "two" and store.read("raw").count() == 1 and rows(store.read("parsed", "one")) == rows(parsed) and store.root_hash("one") != store.root_hash("two")
    assert [(r.snapshot, r.current, r.valid) for r in store.listed(check=False).collect()] == [("one", False, None), ("two", True, None)]


def test_folders_with_faulty_files(spark, tmp_path, rows):
    for name, text in (("a/x.json", '{"id": 1, "tag": "t"}'), ("b/y.json", '{"id": 2,\n "more": {"k": [1]}}'), ("b/z.json", "{broken"), ("c/w.json", "[1]"), ("c/note.txt", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    at = f"file://{tmp_path}"
    docs, bad = documents.read_folder(spark, at, faulty="route")
    assert sorted((r.id, r.tag, r["_file"].rsplit("/", 1)[1]) for r in docs.collect()) == [(1, "t", "x.json"), (2, None, "y.json")] and docs.filter("more.k[0] = 1").count() == 1
    assert sorted(r.file.rsplit("/", 1)[1] for r in bad.collect()) == ["w.json", "z.json"]
    assert documents.read_folder(spark, at, "id int", "empty")[0].count() == 0 and rows(documents.read_folder(spark, f"{at}/a", "id int, tag string", "empty")[0].select("id", "tag")) == [(1, "t")]
    with pytest.raises(ValueError, match="not a JSON document"):
        documents.read_folder(spark, at, "id int")
