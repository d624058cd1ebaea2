"""JSON documents held against rules: what a schema says of the places in a document, and what holds between places.

A document is a variant, parsed once. Its nodes are taken from it in its row, and only along the paths that rules name, so a
document's other parts are never touched. Each rule looks at the nodes of its path; rules
between paths are joins within a document. A path is written with names and [*] for the items of arrays: $.steps[*].id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of rules about one node.
NODE_RULES = ("type", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems", "required", "additional")


@dataclass(frozen=True)
class Rule:
    """What nodes at a path must be. kind is one of NODE_RULES, or unique (no value twice), within or apart (values are, or aren't, among those of the path bound)."""

    path: str
    kind: str
    bound: Any = None

    @property
    def name(self) -> str:
        return f"{self.path} {self.kind}"


def from_schema(schema: dict, path: str = "$", root: dict | None = None) -> list[Rule]:
    """The rules of a JSON schema: type, enum, const, pattern, bounds, required, closed objects, properties, items and local references."""
    root = root or schema
    if "$ref" in schema:
        return from_schema(reduce(lambda at, name: at[name], schema["$ref"].lstrip("#/").split("/"), root), path, root)
    out = []
    if "type" in schema:
        out.append(Rule(path, "type", tuple(schema["type"]) if isinstance(schema["type"], list) else (schema["type"],)))
    if "enum" in schema or "const" in schema:
        out.append(Rule(path, "enum", tuple(schema.get("enum", [schema.get("const")]))))
    out += [Rule(path, k, schema[k]) for k in ("pattern", "minLength", "maxLength", "minimum", "maximum", "minItems", "maxItems") if k in schema]
    if schema.get("required"):
        out.append(Rule(path, "required", tuple(schema["required"])))
    own = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        out.append(Rule(path, "additional", tuple(own)))
    for name, inner in own.items():
        out += from_schema(inner, f"{path}.{name}", root)
    if isinstance(schema.get("items"), dict):
        out += from_schema(schema["items"], f"{path}[*]", root)
    return out


def _steps(path: str) -> list[str]:
    return re.findall(r"\.[^.\[\]]+|\[\*\]", path)


def nodes(documents: DataFrame, key: str, json: str, paths: set[str]) -> DataFrame:
    """(key, path, place, kind, v) of the nodes at paths: kind as JSON names it, place with the numbers of items. A text that isn't JSON has one node of kind invalid."""
    wanted = {"$"} | {"$" + "".join(_steps(p)[:n]) for p in paths for n in range(1, len(_steps(p)) + 1)}
    node = lambda path, place, v: F.struct(F.lit(path).alias("path"), place.alias("place"), v.alias("v"))
    rows = documents.select(F.col(key).alias("key"), F.try_parse_json(json).alias("_v"))
    rows, at = rows.select("key", F.array(node("$", F.lit("$"), F.col("_v"))).alias("_n0")), {"$": "_n0"}
    for path in sorted(wanted - {"$"}, key=lambda p: (len(_steps(p)), p)):
        last = _steps(path)[-1]
        if last == "[*]":
            items = lambda x: F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, n: node(path, F.concat(x["place"], F.lit("["), n.cast("string"), F.lit("]")), v))  # noqa: B023, E731
            made = F.flatten(F.array_compact(F.transform(at[path[: -len(last)]], items)))
        else:
            named = lambda x: node(path, F.concat(x["place"], F.lit(last)), F.try_variant_get(x["v"], f"${last}", "variant"))  # noqa: B023, E731
            made = F.filter(F.transform(at[path[: -len(last)]], named), lambda x: x["v"].isNotNull())
        at[path] = f"_n{len(at)}"
        rows = rows.withColumn(at[path], made)
    # The whole document is a node as well if it isn't JSON.
    asked = [F.col(c) if p in paths else F.filter(c, lambda x: x["v"].isNull()) for p, c in at.items() if p in paths or p == "$"]
    rows = rows.select("key", F.inline(F.concat(*asked)))
    # A node's schema is that of all below it; as a column of its own it is found once, not for each use.
    kind = F.col("_schema")
    named = (F.when(F.col("v").isNull(), "invalid").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
             .when((kind == "BIGINT"), "integer").otherwise("number"))
    return rows.withColumn("_schema", F.schema_of_variant("v")).withColumn("kind", named).drop("_schema")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _fault(rule: Rule) -> Column:
    """What is wrong with a node by a rule, null if nothing is."""
    v, kind, b = F.col("v"), F.col("kind"), rule.bound
    number, text = F.when(kind.isin("integer", "number"), F.try_variant_get(v, "$", "double")), F.when(kind == "string", _text(v))
    size = F.when(kind == "array", F.size(F.try_variant_get(v, "$", "array<variant>")))
    names = F.map_keys(F.when(kind == "object", F.try_variant_get(v, "$", "map<string,variant>")))
    if rule.kind == "type":
        fits = kind.isin(*b) | (F.lit("number" in b) & (kind == "integer"))
        return F.when(~fits, kind)
    if rule.kind == "enum":
        known = [str(x).lower() if isinstance(x, bool) else "null" if x is None else str(x) for x in b]
        return F.when(~F.coalesce(_text(v), F.lit("null")).isin(known), F.coalesce(_text(v), F.lit("null")))
    if rule.kind == "pattern":
        return F.when(~text.rlike(b), text)
    if rule.kind in ("minLength", "maxLength"):
        return F.when(F.length(text) < b if rule.kind == "minLength" else F.length(text) > b, F.length(text).cast("string"))
    if rule.kind in ("minimum", "maximum"):
        return F.when(number < b if rule.kind == "minimum" else number > b, _text(v))
    if rule.kind in ("minItems", "maxItems"):
        return F.when(size < b if rule.kind == "minItems" else size > b, size.cast("string"))
    given = F.array(*map(F.lit, b)).cast("array<string>")
    lost = F.array_except(given, names) if rule.kind == "required" else F.array_except(names, given)
    return F.when(F.size(lost) > 0, F.array_join(F.array_sort(lost), ","))


def faults(documents: DataFrame, key: str, json: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, place, found): every rule that a document breaks, where, and what stands there. A text that isn't JSON breaks the rule "$ json"."""
    paths = {r.path for r in rules} | {r.bound for r in rules if r.kind in ("within", "apart")}
    cells = [F.when(F.col("kind") == "invalid", F.struct(F.lit("$ json").alias("rule"), F.lit("invalid").alias("found")))]
    for rule in (r for r in rules if r.kind in NODE_RULES):
        wrong = F.when((F.col("path") == rule.path) & (F.col("kind") != "invalid"), _fault(rule))
        cells.append(F.when(wrong.isNotNull(), F.struct(F.lit(rule.name).alias("rule"), wrong.alias("found"))))
    between = [r for r in rules if r.kind not in NODE_RULES]
    asked = F.col("path").isin(sorted({p for r in between for p in (r.path, r.bound) if p in paths})) & ~F.col("kind").isin("object", "array", "null", "invalid")
    # Faults, and with no rule the values that rules between places ask for. A filter on them would compute them twice.
    cells.append(F.when(asked, F.struct(F.lit(None).cast("string").alias("rule"), _text(F.col("v")).alias("found"))))
    every = nodes(documents, key, json, paths).select("key", "path", "place", F.explode(F.array_compact(F.array(*cells))).alias("_f")).select("key", "path", "place", "_f.rule", "_f.found")
    if between:
        from lodeworks.sources.snapshots import cut

        every = cut(every)  # which several rules ask
    out = every.filter("rule is not null").select("key", "rule", "place", "found")
    values = lambda p: every.filter((F.col("path") == p) & F.col("rule").isNull()).select("key", "place", "found")
    for rule in rules:
        if rule.kind == "unique":
            twice = values(rule.path).groupBy("key", "found").agg(F.count("*").alias("_n"), F.min("place").alias("place")).filter("_n > 1")
            out = out.unionByName(twice.select("key", F.lit(rule.name).alias("rule"), "place", "found"))
        elif rule.kind in ("within", "apart"):
            met = values(rule.path).join(values(rule.bound).select("key", "found").distinct(), ["key", "found"], "left_anti" if rule.kind == "within" else "left_semi")
            out = out.unionByName(met.select("key", F.lit(rule.name).alias("rule"), "place", "found"))
    return out


def on_cycles(edges: DataFrame) -> DataFrame:
    """(key, node) of the nodes of each document's edges (key, src, dst) that lie on a cycle or between two, by taking off ends until none is left."""
    from lodeworks.sources.snapshots import cut

    now = cut(edges.select("key", "src", "dst").distinct())
    while True:
        n = now.count()
        now = cut(now.join(now.select("key", F.col("src").alias("dst")).distinct(), ["key", "dst"], "left_semi").select("key", "src", "dst").join(now.select("key", F.col("dst").alias("src")).distinct(), ["key", "src"], "left_semi").select("key", "src", "dst"))
        if now.count() == n:
            return now.select("key", F.col("src").alias("node")).union(now.select("key", "dst")).distinct()


# ---- the documents of a controlled task

_ID = "^[a-z0-9][a-z0-9._-]*$"
#: A path below its root: no drive, no leading slash, no step upwards.
PORTABLE = r"^(?!/)(?![A-Za-z]:)(?!(?:.*/)?\.\.(?:/|$))[^\\]+$"
ACCEPTANCE = [Rule("$.criteria[*].id", "pattern", _ID), Rule("$.criteria[*].id", "unique")]
POLICY = [Rule("$.allowedPaths[*]", "apart", "$.deniedPaths[*]")]
PLAN = [Rule("$.steps[*].id", "pattern", _ID), Rule("$.steps[*].id", "unique"), Rule("$.steps[*].cwd", "pattern", PORTABLE), Rule("$.steps[*].dependencies[*]", "within", "$.steps[*].id")]


def plan_edges(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, src, dst): which step of a plan waits for which."""
    found = nodes(documents, key, json, {"$.steps[*].id", "$.steps[*].dependencies[*]"})
    step = F.regexp_extract("place", r"^(\$\.steps\[\d+\])", 1)
    ids = found.filter("path = '$.steps[*].id'").select("key", step.alias("_s"), _text(F.col("v")).alias("src"))
    needs = found.filter("path = '$.steps[*].dependencies[*]'").select("key", step.alias("_s"), _text(F.col("v")).alias("dst"))
    return ids.join(needs, ["key", "_s"]).select("key", "src", "dst").filter("src is not null and dst is not null")
