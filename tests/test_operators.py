"""Operators on literal rows: ties, nulls, empty tables, and cases that the driver tables don't have."""

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import apidoc, hashing, markup, paths
from lodeworks.functions import text as T
from lodeworks.operators import classify, diff, graph, joins, logs, quality, ranking, retrieval, sequence

C = F.col


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("path", "category"), [("dist/a.ts", "generated"), ("package.json", "manifest"), ("README.md", "documentation"), ("demo/a.vue", "example"), ("src/a.test.ts", "test"), ("scripts/x.sh", "build"), ("tsconfig.base.json", "config"), ("src/a.scss", "style"), ("src/a.ts", "source"), ("img/a.png", "asset"), ("LICENSE", "other")])
def test_file_category(spark, path, category):
    assert one(spark, classify.file_category(C("p")), p=path) == category


@pytest.mark.parametrize(("glob", "path", "dialect", "hit"), [("docs/**/x", "docs/x", "catalog", False), ("docs/**/x", "docs/x", "symbols", True), ("docs/**/x", "docs/a/b/x", "task", True), ("a?.ts", "ab.ts", "task", True), ("a?.ts", "ab.ts", "symbols", False), ("*.ts", "a/b.ts", "task", False)])
def test_globs(spark, glob, path, dialect, hit):
    assert one(spark, paths.matches_any(C("p"), [glob], dialect), p=path) is hit


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\rb\n", 2), ("\n", 1)])
def test_line_count(spark, text, n):
    assert one(spark, T.line_count(C("t")), t=text) == n


def test_text_functions(spark):
    assert one(spark, F.array_join(T.split_identifier(C("t")), " "), t="fooBarHTTPServer_x-y") == "foo bar http server x y"
    assert one(spark, F.array_join(T.char_bigrams(C("t")), " "), t="abab") == "ab ba"
    assert one(spark, T.slug(C("t")), t="Größe, (x)!") == "größe-x"
    assert one(spark, T.slug(C("t")), t="!!!").startswith("item-")
    assert one(spark, T.normalize_log(C("t")), t="\x1b[31mred\x1b[0m \r\n\r\n\r\n\r\nx") == "red\n\nx"
    assert one(spark, T.claim_key(C("t")), t="ﬁne  Ａ") == "fine a"
    assert one(spark, paths.relativize(C("t"), F.lit("/src"), F.lit("/lab")), t="/src/a/b.ts?x") == "a/b.ts"
    assert one(spark, paths.relativize(C("t"), F.lit("/src"), F.lit("/lab")), t="/etc/passwd") == "<external>/passwd"
    assert one(spark, hashing.composite_id("x", C("a"), C("b")), a="p", b="q") != one(spark, hashing.composite_id("x", C("a"), C("b")), a="pq", b="")


def test_markdown(spark, rows):
    docs = spark.createDataFrame([(1, "# A\n```\n# no\n```\n## B\n[l](u \"t\") text\n# C"), (2, "```\n# never closed"), (3, None)], "id int, text string")
    found = [(r.id, r.line_no, r.heading, r.line_end, r.parent_line) for r in markup.markdown_sections(docs, "id", "text").orderBy("id", "line_no").collect()]
    assert found == [(1, 1, "A", 6, None), (1, 5, "B", 6, 1), (1, 7, "C", 7, None)]
    assert [tuple(r) for r in markup.markdown_links(docs, "id", "text").collect()] == [(1, 6, "l", "u", False)]


def test_api_tables(spark, rows):
    md = "# Button\n## Attributes\n| Name | Type | Default | Description |\n| --- | --- | --- | --- |\n| size | `string` | - | how big |\n| icon | Slot | | x |\n\ntext\n## Events\n| Event name | Description |\n|---|---|\n| click | a \\| b |\n"
    out = apidoc.api_rows(apidoc.pipe_tables(spark.createDataFrame([(1, md)], "id int, text string"), "id", "text"), "id")
    assert [(r.section, r["name"], r.type, r.default_value, r.description) for r in out.orderBy("line_no").collect()] == [("attributes", "size", "string", None, "how big"), ("slots", "icon", "Slot", None, "x"), ("events", "click", None, None, "a | b")]
    html = "<h2>Methods</h2><table><tr><th>Method name</th><th>Description</th></tr><tr><td>focus()</td><td>sets it</td></tr></table>"
    out = apidoc.api_rows(apidoc.tables_of_html(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html"), "id")
    assert [(r.section, r["name"], r.description) for r in out.collect()] == [("methods", "focus()", "sets it")]


def test_typescript_syntax(spark, rows):
    files = spark.createDataFrame([
        ("src/a.ts", "// export const no = 1\nexport class Foo {}\nexport default function main() {}\nconst local = 1\nexport { local as outer }\n"),
        ("src/index.ts", "import type { Foo } from './a'\nimport def, {\n  outer as o,\n} from './a'\nimport * as ns from 'pkg'\nimport './side'\nexport * from './a'\nexport { Foo as Renamed } from './a'\n"),
        ("src/loop.ts", "export * from './index'\nexport * from './loop'\n"),
    ], "path string, text string")
    assert rows(apidoc.declarations(files).select("path", "kind", "name", "exported", "is_default")) == [("src/a.ts", "class", "Foo", True, False), ("src/a.ts", "function", "main", True, True), ("src/a.ts", "variable", "local", False, False)]
    assert rows(apidoc.imports(files).select("source", "imported", "local")) == sorted([("./a", "Foo", "Foo"), ("./a", "default", "def"), ("./a", "outer", "o"), ("pkg", "*", "ns"), ("./side", None, None)], key=repr)
    found = apidoc.exports(files)
    sources = found.filter("source is not null").select("path", "source").distinct()
    modules = joins.first_resolved(sources.withColumn("key", F.concat_ws("|", "path", "source")), apidoc.module_candidates(C("path"), C("source")), files, "path", ["path", "source"])
    assert rows(modules.select("path", "source", "resolved")) == [("src/index.ts", "./a", "src/a.ts"), ("src/loop.ts", "./index", "src/index.ts"), ("src/loop.ts", "./loop", "src/loop.ts")]
    out = apidoc.resolve_exports(found, modules).filter("path <> 'src/a.ts'").select("path", "exported", "origin", "local", "hops")
    assert rows(out) == [("src/index.ts", "Foo", "src/a.ts", "Foo", 1), ("src/index.ts", "Renamed", "src/a.ts", "Foo", 1), ("src/index.ts", "outer", "src/a.ts", "local", 1),
                         ("src/loop.ts", "Foo", "src/a.ts", "Foo", 2), ("src/loop.ts", "Renamed", "src/a.ts", "Foo", 2), ("src/loop.ts", "outer", "src/a.ts", "local", 2)]


def test_keyed_diff_and_moves(spark, rows):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", None), ("d", "4", "x"), ("e", "9", "x"), ("f", "9", "x")], "k string, h string, c string")
    new = spark.createDataFrame([("a", "1", "x"), ("b", "5", "x"), ("c", "3", None), ("g", "4", "x"), ("h", "9", "x")], "k string, h string, c string")
    assert rows(diff.keyed_diff(old, new, "k", ["h"], "c")) == [("a", "unchanged"), ("b", "modified"), ("c", "unchanged"), ("d", "removed"), ("e", "removed"), ("f", "removed"), ("g", "added"), ("h", "added")]
    assert rows(diff.unique_moves(old, new, "k", "h")) == [("d", "g", "4")]
    assert diff.keyed_diff(old.limit(0), new.limit(0), "k", ["h"]).count() == 0


def greedy(candidates, caps, default, limit):
    out, seen, used = [], set(), {}
    for i, kind, title, score in sorted(candidates, key=lambda c: (-c[3], c[1], c[0])):
        if score <= 0 or len(out) >= limit or (kind, title) in seen or used.get(kind, 0) >= caps.get(kind, default):
            continue
        seen.add((kind, title))
        used[kind] = used.get(kind, 0) + 1
        out.append(i)
    return sorted(out)


def test_capped_topk_equals_the_greedy_choice(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        cs = [(i, r.choice("abc"), r.choice("uvwxyz"), r.randint(-2, 8)) for i in range(60)]
        df = spark.createDataFrame(cs, "id int, kind string, title string, score int")
        out = ranking.capped_topk(df, "score", "kind", ["kind", "title"], {"a": 1, "b": 4}, 2, 6, ["kind", "id"])
        assert sorted(x.id for x in out.collect()) == greedy(cs, {"a": 1, "b": 4}, 2, 6)


def test_budgets(spark, rows):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 30), ("g", 3, 40), ("h", 1, 500)], "g string, o int, n int")
    assert rows(ranking.budget_prefix(df, ["g"], [C("o")], C("n"), 100).select("g", "o", "used")) == [("g", 1, 50), ("g", 2, 81), ("h", 1, 500)]
    assert ranking.trim_phases([[10, 10, 10], [5, 5], [7]], 3, 40, [1, 0, 1]) == [1, 2, 1]
    assert ranking.trim_phases([[10, 10], [5, 5], [7]], 3, 22, [1, 0, 1]) == [1, 0, 1]
    assert ranking.trim_phases([[100]], 0, 10, [1]) is None


def test_sequential_pick(spark):
    df = spark.createDataFrame([(1, 1, "a", "f", 1, 5, False), (1, 2, "b", "f", 1, 5, False), (1, 3, "a", "f", 9, 9, True), (1, 4, "a", "g", 1, 2, False), (1, 5, "b", "g", 3, 4, False)], "q int, o int, t string, f string, s int, e int, skip boolean")
    out = ranking.sequential_pick(df, "q", ["o"], "t", {"a": 2}, 9, "f", "s", "e", "skip")
    assert sorted(r.o for r in out.collect()) == [1, 5]


def test_joins(spark, rows):
    files = spark.createDataFrame([("pkg/a/x.ts",), ("pkg/ab/x.ts",), ("top.ts",)], "path string")
    owners = spark.createDataFrame([(".", "root"), ("pkg/a", "a"), ("pkg", "p")], "dir string, owner string")
    assert rows(joins.longest_prefix(files, "path", owners, "dir", "owner")) == [("pkg/a/x.ts", "a"), ("pkg/ab/x.ts", "p"), ("top.ts", "root")]
    names = spark.createDataFrame([("button",), ("ab",), ("none",), ("",)], "n string")
    terms = spark.createDataFrame([("the button here", 2), ("but", 3), ("xabx", 1), ("b", 9)], "t string, o int")
    assert rows(joins.containment(names, "n", terms, "t", "o").select("n", "t")) == [("ab", "xabx"), ("button", "the button here")]
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(joins.two_way_gaps(a, b, "k")) == [(1, "unimplemented"), (3, "undocumented")]


def test_graph(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "entity string")
    # d is reached by two edges and scores twice; the edges back to a score as well.
    assert rows(graph.bounded_scores(seeds, edges, 2)) == [("a", 28, 0), ("b", 22, 1), ("c", 22, 1), ("d", 28, 2)]
    loop = edges.union(spark.createDataFrame([("e", "a")], "src string, dst string"))
    assert ("a", "e", "a>b>d>e") in [(r.start, r.entity, ">".join(r.path)) for r in graph.shortest(graph.paths(seeds, loop, 6)).collect()]
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert rows(graph.levels(nodes, edges)) == [("a", 3), ("b", 2), ("c", 2), ("d", 1), ("e", 0)]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(nodes, loop, most=12)


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, "draft"), (1, 2, "validated"), (1, 3, "closed"), (2, 1, "closed")], "t int, o int, s string")
    out = sequence.chain(df, ["t"], ["o"], "s", sequence.TASK_STATES, ["draft"])
    assert sorted((r.t, r.o) for r in out.filter(~C("legal")).collect()) == [(1, 3), (2, 1)]
    steps = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False)], "r int, o int, bad boolean")
    assert [r.skipped for r in sequence.skip_after_failure(steps, ["r"], ["o"], C("bad")).orderBy("o").collect()] == [False, False, True]


LOG = {
    "eslint": ("/src/app/a.ts\n  3:7  error  Missing semicolon  semi\n  9:1  warning  Odd\n\n/src/app/b.vue.ts\n  1:2  error  x is 'prettier/prettier' wrong  @x/rule\n", ""),
    "sass": ("", "[vite:css] [sass] Error: Can't find stylesheet to import.\n  /src/app/s.scss 4:9  root stylesheet\n"),
    "typescript": ("src/x.ts(3,4): error TS2322: Type no.\nsrc/y.ts:5:6 - error TS1005: ';' expected.\n", ""),
    "node": ("", "Error: Cannot find module 'left-pad'\n  code: 'MODULE_NOT_FOUND'\n    at load (/x/node_modules/y.js:1:2)\n    at run (/src/app/m.js:7:8)\n"),
    "pnpm": (" ELIFECYCLE  Command failed with exit code 2.\n", ""),
    "silent": ("nothing useful\nit failed somewhere\n", ""),
}


def test_log_parsers(spark):
    steps = spark.createDataFrame([("r", k, i, "failed", k == "pnpm", 1, o, e, "/src/app", "/lab") for i, (k, (o, e)) in enumerate(LOG.items())],
                                  "run_id string, step_id string, ordinal int, status string, allow_failure boolean, exit_code int, stdout string, stderr string, source_root string, lab_root string")
    events = logs.parse(steps)
    found = {(r.step_id, r.parser, r.severity, r.file, r.line, r.rule or r.code) for r in events.collect()}
    assert ("eslint", "eslint", "error", "a.ts", 3, "semi") in found
    assert ("eslint", "eslint", "warning", "a.ts", 9, None) in found
    assert ("eslint", "eslint", "error", "b.vue.ts", 1, "@x/rule") in found
    assert ("sass", "sass", "error", "s.scss", 4, None) in found
    assert ("typescript", "typescript", "error", "src/x.ts", 3, "TS2322") in found
    assert ("typescript", "typescript", "error", "src/y.ts", 5, "TS1005") in found
    assert ("node", "node", "error", "m.js", 7, "MODULE_NOT_FOUND") in found
    assert ("pnpm", "pnpm-lifecycle", "error", None, None, "ELIFECYCLE") in found
    assert ("silent", "generic", "error", None, None, None) in found
    first = logs.first_blocking(events).first()
    assert (first.step_id, first.parser, first.score) == ("eslint", "eslint", 15)
    again = logs.parse(steps.union(steps))
    assert again.count() == events.count()


def test_quality_and_reconciliation(spark, rows):
    v = spark.createDataFrame([("c", "size", "official-doc", 0, "String", "1", "x"), ("c", "size", "source-code", 1, "string ", "1", "x"), ("c", "icon", "official-doc", 2, "Slot", None, "x"), ("c", "mode", "source-code", 3, "a", "1", "y")], "component string, name string, kind string, o int, type string, d string, commit string")
    out = quality.reconcile(v, ["component", "name"], "kind", "o", "type", "d", "commit", F.lit("x"))
    assert {(r["name"], r.status, r.confidence) for r in out.collect()} == {("size", "verified", "high"), ("icon", "documented", "medium"), ("mode", "conflict", "low")}
    facts = spark.createDataFrame([(1, 5, True), (2, 50, None)], "k int, n int, ok boolean")
    assert rows(quality.acceptance(facts, ["k"], {"few": C("n") < 10, "ok": C("ok"), "seen": None})) == [(1, "few", "passed"), (1, "ok", "passed"), (1, "seen", "manual_required"), (2, "few", "failed"), (2, "ok", "blocked"), (2, "seen", "manual_required")]
    assert one(spark, quality.break_even(F.lit(100), F.lit(0)), a=1) is None
    assert quality.statistics(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 9.0)], "g int, v double"), ["g"], "v").first()["median"] == 3.0


def test_retrieval(spark):
    task = retrieval.profile("Fix the `NcButton` size in src/button.ts, do not change the docs")
    assert "NcButton" in task.identifiers and "src/button.ts" in task.paths and task.forbidden == ["change the docs"]
    symbols = spark.createDataFrame([("s1", "NcButton", "NcButton", True, "high"), ("s2", "nc-button", "x", False, "low"), ("s3", "Other", "Other", True, "high")], "id string, name string, qualified_name string, public_reachable boolean, confidence string")
    parts = spark.createDataFrame([("c1", "NcButton", True, "high")], "id string, name string, public_reachable boolean, confidence string")
    edges = spark.createDataFrame([("s1", "s3")], "src string, dst string")
    entities = spark.createDataFrame([("s1", "symbol", "NcButton", "a"), ("s2", "symbol", "nc-button", "b"), ("s3", "symbol", "Other", "c"), ("c1", "component", "NcButton", "a")], "id string, type string, title string, path string")
    own = retrieval.seeds(symbols, parts, task)
    found = {r.id: r.score for r in retrieval.retrieve(entities, [own, retrieval.expansion(own, edges, 1)], limit=10).collect()}
    assert found == {"s1": 155, "s2": 5, "s3": 22, "c1": 215}
    cards = spark.createDataFrame([("k1", "overview", "all about NcButton", True), ("k2", "constraint", "never", False), ("k3", "overview", "no hit", True)], "id string, type string, text string, verified boolean")
    assert [r.id for r in retrieval.ranked_cards(cards, ["NcButton"]).collect()] == ["k2", "k1"]


def test_walks_have_no_fixed_end(spark, rows):
    edges = spark.createDataFrame([(f"n{i + 1:02}", f"n{i:02}") for i in range(14)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(15)], "node string")
    assert rows(graph.skipped_dependents(nodes, edges, nodes.filter("node = 'n00'"))) == [(f"n{i:02}",) for i in range(1, 15)]
    exported = spark.createDataFrame([("m00", "x", "x", None, False)] + [(f"m{i:02}", "x", "x", "./up", True) for i in range(1, 12)], "path string, exported string, local string, source string, re_export boolean")
    modules = spark.createDataFrame([(f"m{i:02}", "./up", f"m{i - 1:02}") for i in range(1, 12)], "path string, source string, resolved string")
    assert rows(apidoc.resolve_exports(exported, modules).select("path", "hops")) == [(f"m{i:02}", i) for i in range(12)]
