"""Symbols, components, task rules, contexts, JSON and Markdown parts, and what once had a bound."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import apidoc, hashing, markup, paths, syntax
from lodeworks.functions import text as T
from lodeworks.operators import components, logs, quality, ranking, retrieval, taskrules
from lodeworks.sources import documents, files, snapshots

C = F.col
SOURCE = '''import { Base } from "./base";
/**
 * A button.
 * @deprecated use other
 * @example <x/>
 */
export default class NcButton<T> extends Base<T, string> implements Shown, Clicked {
  private size?: string = "{";
  /** Presses it. */
  press(times: number, how?: string): void {
    if (times) { return; }
  }
  get label(): string { return "}"; }
  constructor(a: number) { super(); }
}
export interface ButtonProps extends Shown {
  [key: string]: unknown;
}
/* class Hidden {
   x: string } */
export function go(x: Base): void {
}
'''


def tree(spark):
    return spark.createDataFrame([("src/button/index.ts", SOURCE), ("src/base.ts", "export class Base<A, B> {\n}\nexport interface Shown {\n}\n")], "path string, text string")


def test_symbols(spark):
    found = {r.qualified_name: r for r in syntax.symbols(tree(spark)).collect()}
    assert set(found) == {"NcButton", "NcButton.size", "NcButton.press", "NcButton.label", "NcButton.constructor", "ButtonProps", "ButtonProps.index_signature", "go", "Base", "Shown"}
    own = found["NcButton"]
    assert (own.line, own.kind, own.exported, own.is_default, own.summary, own.deprecated, own.examples) == (7, "class", True, True, "A button.", True, ["<x/>"])
    assert own.heritage == ["Base<T, string>", "Shown", "Clicked"] and own.signature.startswith("class NcButton<T> extends Base")
    size, press = found["NcButton.size"], found["NcButton.press"]
    assert (size.kind, size.visibility, size.explicit_visibility, size.optional, size.type) == ("property", "private", True, True, "string")
    assert (press.kind, press.visibility, press.signature, press.summary) == ("method", "public", "press(times: number, how?: string): void", "Presses it.")
    assert (found["NcButton.label"].kind, found["NcButton.constructor"].kind, found["go"].line) == ("getter", "constructor", 21)


def test_components_and_edges(spark, rows):
    found = syntax.symbols(tree(spark))
    assert {(r.src, r.dst) for r in components.heritage_edges(found).collect()} == {("src/button/index.ts#NcButton", "src/base.ts#Base"), ("src/button/index.ts#NcButton", "src/base.ts#Shown"), ("src/button/index.ts#ButtonProps", "src/base.ts#Shown")}
    assert ("src/button/index.ts#go", "src/base.ts#Base") in {(r.src, r.dst) for r in components.reference_edges(found).collect()}
    one = components.components(found, ["src/**/index.ts"], ["Base"], spark.createDataFrame([("src/button/index.ts",)], "path string"), "Nc")
    r = one.first()
    assert (r["name"], r.methods, r.properties, r.props, r.confidence, r.status) == ("NcButton", ["NcButton.label", "NcButton.press"], [], "ButtonProps", "high", "public")
    near = spark.createDataFrame([("src/button/style.scss",), ("examples/a/button.vue",), ("examples/button.vue",), ("docs/button.md",), ("x/button.vue",)], "path string")
    got = components.attachments(one, near, {"style": ["{dir}/style.scss"], "example": ["examples/**/{component}.vue"], "document": ["docs/{basename}.md"]}, "Nc")
    assert {(r.kind, r.file) for r in got.collect()} == {("style", "src/button/style.scss"), ("example", "examples/a/button.vue"), ("example", "examples/button.vue"), ("document", "docs/button.md")}
    members = components.workspace_members(spark.createDataFrame([("r", d) for d in ("packages/a", "packages/b/test", "packages/old", "x")], "root string, directory string"), spark.createDataFrame([("r", ["packages/**", "!packages/old"])], "root string, patterns array<string>"))
    assert rows(members) == [("r", "packages/a"), ("r", "packages/b/test")]
    made = apidoc.imports(tree(spark))
    modules = spark.createDataFrame([("src/button/index.ts", "./base", "src/base.ts")], "path string, source string, resolved string")
    assert [(r.src, r.dst) for r in components.import_edges(made, modules).collect()] == [("src/button/index.ts", "src/base.ts")]


def test_globs_that_are_data_equal_those_that_are_given(spark):
    globs = ["src/**", "**/*.ts", "a?.ts", "docs/**/x", "a.b+c", "*"]
    names = ["src/a/b.ts", "ab.ts", "abc.ts", "docs/x", "docs/a/b/x", "a.b+c", "axb+c", "src"]
    df = spark.createDataFrame([(g, n) for g in globs for n in names], "g string, n string")
    for r in df.select("g", "n", F.rlike("n", paths.glob_regex(C("g"))).alias("hit")).collect():
        assert r.hit == spark.range(1).select(F.lit(r.n).rlike(paths.glob_pattern(r.g, "task"))).first()[0], r
    away = spark.createDataFrame([("a/b", "../c"), ("a/b", "../../c"), ("b", "x/../../y"), ("b", "/etc"), ("a/b/c", "../../d/..")], "p string, t string")
    assert [r[0] for r in away.select(paths.escapes_root(C("p"), C("t"))).collect()] == [False, True, True, True, False]


@pytest.mark.parametrize(("kind", "want", "status"), [
    ("source_change", {"glob": "src/**"}, "passed"), ("source_change", {"minimum": 9}, "failed"), ("file_exists", {"path": "src/a.ts"}, "passed"), ("file_exists", {"path": "no.ts"}, "failed"), ("file_not_changed", {"path": "lock"}, "passed"),
    ("file_not_changed", {"path": "src/a.ts"}, "failed"), ("path_allowed", {"paths": ["src/**"]}, "failed"), ("path_allowed", {}, "passed"), ("path_denied", {"glob": "docs/*"}, "failed"), ("path_denied", {}, "passed"), ("text_present", {"path": "src/a.ts", "text": "two"}, "passed"),
    ("text_absent", {"path": "src/a.ts", "regex": "^two$"}, "failed"), ("text_absent", {"path": "no.ts", "text": "x"}, "failed"), ("export_present", {"path": "src/a.ts", "text": "three"}, "failed"), ("symbol_used", {"path": "src/a.ts", "regex": "t[wo]+"}, "passed"),
    ("command_passes", {"step_id": "ok"}, "passed"), ("http_status", {"step_id": "bad"}, "failed"), ("command_passes", {"step_id": "later"}, "failed"), ("manual_check", {}, "manual_required"), ("browser_check", {}, "manual_required"), ("custom", {}, "manual_required"), ("other", {}, "failed"),
])
def test_criteria(criteria_results, kind, want, status):
    assert criteria_results[kind, str(want)] == status


@pytest.fixture(scope="module")
def criteria_results(spark):
    cases = [m.args[1] for m in test_criteria.pytestmark if m.name == "parametrize"][0]
    names = [x.split(":")[0] for x in taskrules.EXPECTED[7:-1].split(",")]
    given = [(1, f"{k}{w}", k, True, tuple(w.get(n) for n in names)) for k, w, _ in cases]
    criteria = spark.createDataFrame(given, f"task_id int, id string, type string, automated boolean, expected {taskrules.EXPECTED}")
    changed = spark.createDataFrame([(1, "src/a.ts", False), (1, "docs/b", False), (1, "dist/c", True), (2, "lock", False)], "task_id int, path string, generated boolean")
    content = spark.createDataFrame([(1, "src/a.ts", "one\ntwo\n")], "task_id int, path string, content string")
    steps = spark.createDataFrame([(1, "ok", "passed"), (1, "bad", "failed")], "task_id int, step_id string, status string")
    found = {r.id: r.status for r in taskrules.criteria_verdicts(criteria, changed, content, steps).collect()}
    early = {r.id: r.status for r in taskrules.criteria_verdicts(criteria, changed, content, steps, before=True).collect()}
    assert {k for k in found if found[k] != early[k]} == {"command_passes{'step_id': 'later'}"} and "skipped" in early.values()
    return {(k, str(w)): found[f"{k}{w}"] for k, w, _ in cases}


def test_policy(spark):
    names = "task_id int, allowed array<string>, denied array<string>, allowed_untracked array<string>, denied_extensions array<string>, max_changed int, max_added int, max_deleted int, max_diff_lines int, allow_untracked boolean, lockfiles_read_only boolean, manifests_read_only boolean, no_conflict_markers boolean, require_patch boolean"
    own = (["src/**"], ["src/secret/**"], ["src/new/**"], [".png"], 3, 1, 0, 10, True, True, True, True, True)
    policies = spark.createDataFrame([(i, *own) for i in (1, 2, 3)], names)
    rows = [(1, "src/a.ts", "modified"), (1, "src/new/b.ts", "untracked"), (2, "src/secret/x.png", "deleted"), (2, "docs/y", "added"), (2, "src/z", "untracked"), (2, "src/pnpm-lock.yaml", "modified"), (2, "src/package.json", "modified")]
    changed = spark.createDataFrame([(*r, False, r[0] == 2, r[0] == 2, r[0] == 2) for r in rows] + [(1, "dist/x", "added", True, True, True, True)], "task_id int, path string, status string, generated boolean, is_binary boolean, is_submodule boolean, has_conflict boolean")
    seen = spark.createDataFrame([(1, 5, True, True), (2, 99, False, False)], "task_id int, diff_lines int, head_matches boolean, has_patch boolean")
    rules = taskrules.policy_rules(policies, changed, seen)
    assert rules.filter("task_id = 1").count() == 15
    found = {r.task_id: (r.status, len(r.failed)) for r in taskrules.policy_results(rules).collect()}
    assert found[1] == ("passed", 0) and found[2] == ("failed", 15) and found[3][0] == "failed"


def test_two_variants_side_by_side(spark):
    tasks = spark.createDataFrame([("t", ["Alpha", "beta"], ["bad"], 1), ("u", [], [], 0)], "id string, must_recall array<string>, must_not_include array<string>, allowed_raw_fallback int")
    raw = spark.createDataFrame([("t", "alpha beta BAD " * 4, 3), ("u", "x", 0)], "task_id string, markdown string, fallbacks int")
    short = spark.createDataFrame([("t", "alpha", 1), ("u", "y", 1)], "task_id string, markdown string, fallbacks int")
    found = {r.id: r for r in taskrules.compared(tasks, raw, short).collect()}
    t, u = found["t"], found["u"]
    assert (t.raw_recall, t.raw_prohibited, t.knowledge_recall, t.knowledge_tokens, t.delta_tokens, t.length, t.within_allowance) == (1.0, 1, 0.5, 2, -13, "shorter", True)
    assert (u.length, u.raw_recall, u.within_allowance) == ("tie", 1.0, False)


def test_context_equals_trimming_one_by_one(spark):
    r = random.Random(4)
    phases, items, want = ["units", "cards", "examples"], [], {}
    for g in range(60):
        own = [[r.randint(1, 30) for _ in range(r.randint(0, 6))] for _ in phases]
        items += [(g, p, i, n) for p, xs in zip(phases, own, strict=True) for i, n in enumerate(xs)]
        left, keep = [len(x) for x in own], [1, 0, 0]
        for p in (2, 1, 0):
            while sum(sum(x[:n]) for x, n in zip(own, left, strict=True)) > 70 and left[p] > keep[p]:
                left[p] -= 1
        want |= {(g, p, i) for p, n in zip(phases, left, strict=True) for i in range(n)} and {(g, p, i): True for p, n in zip(phases, left, strict=True) for i in range(n)}
    df = spark.createDataFrame(items, "g int, phase string, place int, tokens int")
    found = {(x.g, x.phase, x.place) for x in taskrules.context(df, ["g"], phases, 80, {"units": 1}, constant=10).collect()}
    assert found == set(want)


def test_published_units(spark):
    units = spark.createDataFrame([("a", "component_api", "ncbutton size prop", ["x"], True, "published", None, "c"), ("b", "lifecycle", "size of things and prop", None, None, "published", "current", "c"), ("d", "lifecycle", "size", None, None, "published", "stale", "c"), ("e", "topic", "size prop", ["family"], False, "draft", None, "c")],
                                  "id string, type string, text string, tags array<string>, verified boolean, status string, freshness string, commit string")
    asked = retrieval.published(units, ["size", "prop", "ncbutton"], ["ncbutton"], "c")
    assert [(r.id, r.category, r.score) for r in asked.collect()] == [("a", "exact_component", 320), ("b", "mechanism", 80)]
    assert [r.id for r in retrieval.published(units, ["size", "prop"], [], stale=True).collect()] == ["b", "d"]
    assert spark.range(1).select(taskrules.terms_of(F.lit("The ncbutton component, a 事件 Size size"))).first()[0] == ["the", "ncbutton", "size"]
    points = spark.createDataFrame([("a", "exact", 120), ("a", "low", -20), ("a", "exact", 5)], "candidate string, key string, value long")
    assert tuple(retrieval.explained(points).first()) == ("a", 105, "exact +125; low -20")
    packages = spark.createDataFrame([("p", "@x/kit"), ("q", "core"), ("r", "none")], "id string, name string")
    assert {(r.candidate, r.key) for r in retrieval.package_rows(packages, retrieval.profile("use core and kit")).collect()} == {("p", "package"), ("q", "package_exact")}


def test_json_and_markdown_parts(spark, rows):
    df = spark.createDataFrame([(1, '{"main": "./a.js", "exports": {".": {"import": "./m.js", "types": ["./t.d.ts", 3]}}, "n": null, "s": "plain"}'), (2, "[1, [2]]"), (3, "no json"), (4, None)], "k int, j string")
    found = {(r.k, r.path, r.value) for r in documents.json_leaves(df, "k", "j").collect()}
    assert found == {(1, "$.main", "./a.js"), (1, "$.exports...import", "./m.js"), (1, "$.exports...types[0]", "./t.d.ts"), (1, "$.exports...types[1]", "3"), (1, "$.s", "plain"), (2, "$[0]", "1"), (2, "$[1][0]", "2")}
    assert {r.target for r in documents.json_references(df, "k", "j").collect()} == {"./a.js", "./m.js", "./t.d.ts"}
    assert df.select(documents.string_record(C("j"))).first()[0] == {"main": "./a.js", "s": "plain"}
    text = "# My title #\n```ts\n# no\n```\nx\n```\nopen"
    md = spark.createDataFrame([(1, text), (2, None), (3, "none")], "k int, t string")
    assert rows(markup.markdown_code_blocks(md, "k", "t")) == [(1, 2, "ts", "# no"), (1, 6, None, "open")]
    assert [r[0] for r in md.select(markup.markdown_title(C("t"))).collect()] == ["My title", None, None]
    page = spark.createDataFrame([(1, '<pre><code class="hl language-ts">a &lt; <b>b</b> &amp;&amp; c</code></pre><pre>x</pre>')], "k int, h string")
    assert rows(markup.html_code_blocks(page, "k", "h")) == [(1, 0, "ts", "a < b && c"), (1, 1, None, "x")]
    assert [r[0] for r in spark.createDataFrame([(1234,), (None,)], "m int").select(T.seconds(C("m"))).collect()] == ["1.234 s", "-"]


def test_manifests_and_listings(spark, tmp_path, rows):
    for name, text in (("a.txt", "a"), ("d/b.txt", "b"), ("c.txt", "c")):
        (tmp_path / "x" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "x" / name).write_text(text)
    made = spark.createDataFrame(files.manifest(spark, f"file://{tmp_path}/x").collect())
    (tmp_path / "x/a.txt").write_text("changed")
    (tmp_path / "x/c.txt").unlink()
    (tmp_path / "x/new").write_text("n")
    assert rows(files.manifest_faults(made, files.manifest(spark, f"file://{tmp_path}/x"))) == [("a.txt", "changed"), ("c.txt", "missing"), ("new", "unexpected")]
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/s", "id")
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert store.write(one, "s1") == "written" and store.write(one, "s2") == "written" and store.write(one.limit(0), "s1", force=True) == "written"
    assert [(r.snapshot, r.current, r.valid) for r in store.listed().orderBy("snapshot").collect()] == [("s1", True, True), ("s2", False, True)]
    assert store.read("s1").count() == 0 and store.current() == "s1"


def test_beyond_the_old_bounds(spark, monkeypatch):
    names = ",\n".join(f"  name{i}" for i in range(60))
    src = spark.createDataFrame([("a/b/c.ts", f"import {{\n{names}\n}} from '../../../d/./e/../f.js';\nexport {{\n{names}\n}};\nconst x = {{\n  y: 1,\n}};\n")], "path string, text string")
    assert apidoc.imports(src).count() == 60 and apidoc.exports(src).count() == 60
    deep = "/".join(["x"] * 30) + "/" + "/".join([".."] * 29)
    got = spark.createDataFrame([("a/b.ts", "./" + deep), ("a/b/c.ts", "../../d/./e/../f.js"), ("a.ts", "../up")], "p string, s string").select(apidoc.module_candidates(C("p"), C("s"))[0]).collect()
    assert [r[0] for r in got] == ["a/x", "d/f.js", "../up"]
    places = ranking.ranked(spark.range(5000).withColumn("v", (C("id") * 7919) % 5003), [C("v").desc(), C("id")], "place")
    want = sorted(range(5000), key=lambda i: (-(i * 7919 % 5003), i))
    assert {r.id: r.place for r in places.collect()} == {i: k + 1 for k, i in enumerate(want)}
    rows = [(g, v) for g in ("a", "b", None) for v in ([1.0, 2.0, 2.0, 9.0] if g == "a" else [3.0, 1.0, 2.0, None] if g else [])] + [(None, None), ("c", 5.0)]
    found = {r.g: (r.n, r["median"]) for r in quality.statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert found == {"a": (4, 2.0), "b": (3, 2.0), None: (0, None), "c": (1, 5.0)}
    df = spark.range(3000).withColumn("d", F.sha2(C("id").cast("string"), 256))
    before = hashing.root_hash(df, "id", C("d")).first()[0]
    monkeypatch.setattr(hashing, "FAN", 4)
    assert hashing.root_hash(df.repartition(7), "id", C("d")).first()[0] == hashing.root_hash(df, "id", C("d")).first()[0] != before


def test_criteria_are_not_broadcast(spark):
    from lodeworks.plans import QUERIES

    df = QUERIES["criteria_verdicts"](spark, "/root/testdata/sf0.001")
    assert df.count() and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_gap_of_customers_without_orders(spark, tmp_path):
    import duckdb

    from lodeworks.plans import ORACLES, QUERIES

    spark.createDataFrame([(1, "BUILDING"), (2, "BUILDING"), (3, "AUTOMOBILE")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 2, "P", "1-URGENT"), (2, 2, None, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = sorted(map(tuple, QUERIES["gap_priority"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(ORACLES["gap_priority"]).fetchall()) and found[0] == (1, "uncovered", 10, 11)


def test_root_hash_is_the_same_however_many_rows_there_are(spark, monkeypatch):
    df = spark.range(3000).select("id", (C("id") % 3).alias("task"), F.sha2(C("id").cast("string"), 256).alias("d"))
    found = lambda: (hashing.root_hash(df, "id", C("d"), digits=2).first()[0], sorted(map(tuple, hashing.root_hash(df, "id", C("d"), by=["task"], digits=2).collect())))
    few = found()
    monkeypatch.setattr(hashing, "FAN", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    many = found()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many == few


def test_files_of_one_partition_are_parsed_in_several_tasks(spark):
    files = spark.range(40).coalesce(1).select(C("id").cast("string").alias("path"), F.lit("const a = 1\n").alias("text"))
    assert syntax.file_statements(files).select(F.spark_partition_id()).distinct().count() > 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_and_exports_parse_their_files_once(spark):
    files = spark.createDataFrame([("a.ts", "import a, { b as c } from './x'\nimport 'y'\nexport { c }\nexport * from './z'\nexport default class K {}\n")], "path string, text string")
    inward, outward = apidoc.imports(files), apidoc.exports(files)
    assert plan_of(inward).count("MapInArrow") == plan_of(outward).count("MapInArrow") == 1
    assert sorted((r.source, r.imported, r.local) for r in inward.filter("imported is not null").collect()) == [("./x", "b", "c"), ("./x", "default", "a")] and inward.count() == 3
    assert sorted((r.exported, r.local, r.source, r.re_export) for r in outward.collect()) == [("*", "*", "./z", True), ("c", "c", None, False), ("default", "K", None, False)]


def test_symbol_statistics_read_each_table_once(spark):
    from lodeworks.operators import components

    files = spark.createDataFrame([("a.ts", "export const a = 1\nclass B { x: number }\n")], "path string, text string")
    found = components.symbol_statistics(syntax.symbols(files), apidoc.imports(files).withColumn("resolved", F.lit("x")), apidoc.exports(files))
    assert plan_of(found).count("MapInArrow") == 1
    n = {(r.measure, r.key): r.n for r in found.collect()}
    assert n["declarations", None] == 3 and n["members", None] == n["exported_symbols", None] == n["exports", None] == 1 and n["imports", None] == n["re_exports", None] == 0 and n["largest_modules", "a.ts"] == 3


def test_symbol_edges_parse_their_files_once(spark):
    from lodeworks.plans import QUERIES

    assert "MapInArrow" not in plan_of(QUERIES["symbol_edges"](spark, "/root/testdata/sf0.001"))


def test_contexts_of_dealt_blocks_are_not_dealt_again(spark):
    from lodeworks.operators import contexts

    blocks = spark.createDataFrame([(1, "a", 1, "x", "xx", [("p", "pp")]), (1, "a", 2, "y", "yy", [("p", "pp"), ("q", "q")]), (2, "a", 1, "x", "x", None)], "task_id int, phase string, place int, id string, text string, needs array<struct<piece:string,text:string>>")
    done = contexts.trimmed(blocks.repartition("task_id"), None, ["a"], 2)
    assert plan_of(done).count("Exchange") == 1
    assert sorted((r.task_id, r.id, r.kept, r.chars) for r in done.collect()) == [(1, "x", True, 6), (1, "y", False, 6), (2, "x", True, 2)]


def test_logs_without_roots_and_with_roots_in_other_case(spark):
    names = "run_id string, step_id string, ordinal int, status string, allow_failure boolean, exit_code int, stdout string, stderr string, source_root string, lab_root string"
    log = "TypeError: {}\n    at f (/Src/App/m.js:1:2)\n"
    steps = spark.createDataFrame([("r", "s", 0, "failed", False, 1, log.format("one"), log.format("two"), None, None), ("q", "s", 0, "timed_out", None, None, None, None, "/src/app", None), ("p", "s", 0, "failed", False, 1, log.format("in /SRC/app/x"), None, "/src/app", "/lab")], names)
    found = {(r.run_id, r.message, r.file, r.blocking) for r in logs.parse(steps).collect()}
    assert {("r", "TypeError: one", "<external>/m.js", True), ("r", "TypeError: two", "<external>/m.js", True), ("q", "Command timed out in step s", None, True)} <= found
    assert any(x[1] == "TypeError: in <source>/x" for x in found)


FORMS = r'''
import type { A, B as C } from "./a";
import x = require("y");
const re = /[{]/;
const t = `a ${ { b: `}${1}` } } {`, b = 2
export const m = new Map<string, number>(), z: Array<{ a: string, b: number }> = [], q = a < b
/** Doc
 * of two. */
@Component({ a: 1 })
export class Two<T extends { x: string }>
  extends Base<T, { a: string }>
  implements I, J
{
  @Input() name: string = "{"
  private readonly h = (x: number): void => { foo() }
  run(
    a: string,
    b: Map<string, number> = new Map(),
    ...rest: number[]
  ): { a: string } {
    return { a }
  }
  [Symbol.iterator]() { return 1 }
  static { init() }
  get v(): number { return 1 } set v(x: number) {}
  *gen<T>(x: T) { yield /}/ }
  a = 1; b?: string; constructor(private c: string) { super() }
  optional?(): void;
  cb: (x: number) => void
}
export default function () {}
class One { a: string; m(): void {} }
namespace N.M { export interface P { x: string, y(): void; [k: string]: any
 (z: number): string
 new (z: number): P }
  namespace Deep { export const inner = 1 } }
export const enum E { A = 1 << 2, B, "C-D" = 3 }
declare global { interface Window { w: 1 } }
type U = | { a: 1 }
  | { b: 2 }
function over(a: string): void
function over(a: number): void
function over(a: any) { import("dyn"); const hidden = 1 }
const { d1, d2 } = obj
export default foo({ a: 1 })
export const last = 1
'''


def test_symbols_of_ordinary_code(spark):
    found = syntax.symbols(spark.createDataFrame([("f.ts", FORMS), ("none.ts", None), ("empty.ts", "")], "path string, text string")).collect()
    assert [(r.line, r.kind, r.qualified_name) for r in sorted(found, key=lambda r: (r.line, r.qualified_name))] == [
        (4, "variable", "re"), (5, "variable", "b"), (5, "variable", "t"), (6, "variable", "m"), (6, "variable", "q"), (6, "variable", "z"), (9, "class", "Two"), (14, "property", "Two.name"), (15, "property", "Two.h"), (16, "method", "Two.run"), (23, "method", "Two.[Symbol.iterator]"),
        (25, "getter", "Two.v"), (25, "setter", "Two.v"), (26, "method", "Two.gen"), (27, "property", "Two.a"), (27, "property", "Two.b"), (27, "constructor", "Two.constructor"), (28, "method", "Two.optional"), (29, "property", "Two.cb"),
        (31, "function", "anonymous"), (32, "class", "One"), (32, "property", "One.a"), (32, "method", "One.m"), (33, "namespace", "N.M"), (33, "interface", "N.M.P"), (33, "index_signature", "N.M.P.index_signature"), (33, "property", "N.M.P.x"), (33, "method", "N.M.P.y"),
        (34, "call_signature", "N.M.P.call_signature"), (35, "construct_signature", "N.M.P.construct_signature"), (36, "namespace", "N.M.Deep"), (36, "variable", "N.M.Deep.inner"), (37, "enum", "E"), (37, "enum_member", "E.A"), (37, "enum_member", "E.B"), (37, "enum_member", "E.C-D"),
        (38, "namespace", "global"), (38, "interface", "global.Window"), (38, "property", "global.Window.w"), (39, "type_alias", "U"), (41, "function", "over"), (42, "function", "over"), (43, "function", "over"), (44, "variable", "{ d1, d2 }"), (46, "variable", "last")]
    by = {r.qualified_name: r for r in found}
    two, run = by["Two"], by["Two.run"]
    assert two.heritage == ["Base<T, { a: string }>", "I", "J"] and two.type_parameters == ["T extends { x: string }"] and (two.exported, two.summary, two.end_line) == (True, "Doc of two.", 30)
    assert two.signature == "class Two<T extends { x: string }> extends Base<T, { a: string }> implements I, J"
    assert [tuple(p) for p in run.parameters] == [("a", "string", False, False), ("b", "Map<string, number>", True, False), ("rest", "number[]", False, True)] and run.return_type == "{ a: string }" and run.end_line == 22
    assert (by["Two.h"].modifiers, by["Two.h"].visibility, by["Two.name"].type, by["Two.cb"].type, by["Two.b"].optional) == (["private", "readonly"], "private", "string", "(x: number) => void", True)
    assert (by["z"].type, by["z"].exported, by["U"].type, by["E"].signature, by["anonymous"].is_default) == ("Array<{ a: string, b: number }>", True, "| { a: 1 } | { b: 2 }", "enum E", True)


def test_imports_and_exports_of_ordinary_code(spark, rows):
    files = spark.createDataFrame([("f.ts", FORMS)], "path string, text string")
    assert rows(apidoc.imports(files).select("line", "source", "imported", "local", "type_only")) == [(2, "./a", "A", "A", True), (2, "./a", "B", "C", True), (3, "y", "*", "x", False), (43, "dyn", "*", None, False)]
    assert rows(apidoc.exports(files).select("line", "exported", "local")) == sorted([(6, "m", "m"), (6, "q", "q"), (6, "z", "z"), (9, "Two", "Two"), (31, "default", "anonymous"), (37, "E", "E"), (45, "default", "foo({ a: 1 })"), (46, "last", "last")], key=repr)


@pytest.mark.parametrize("odd", ["{" * 50_000, "}" * 50_000, "`${" * 30_000, '"\\"' * 30_000, "'" * 50_001, "/" * 50_001, "a<" * 30_000, "class A {" * 5_000, "@" * 30_000, "/*" * 30_000, "const a=1," * 20_000, "f(a," * 20_000, "`" * 30_001, "x\n" * 30_000, "class A<" * 20_000, "/[" * 30_000])
def test_odd_sources_are_read_in_time(odd):
    import time

    from lodeworks.functions.lexer import statements

    began = time.process_time()
    statements(odd)
    assert time.process_time() - began < 10
