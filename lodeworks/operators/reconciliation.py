"""Knowledge about components from documents and sources side by side: what agrees, what conflicts, and where each value is from.

A value is a row: component, item_kind, name, source (its kind of origin), type, default_value, commit, evidence, ordinal.
Values of one item meet by their name in lower case without separators. Only counts and firsts are made over a group, and
the list of its own origins, which is as long as the item has values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.operators import joins, quality

DOC, CODE, TYPES = "official-doc", "source-code", "type-definition"
#: Members that a component has for its framework, not for its users. Fixed values.
OWN_MEMBERS = ("template", "observedAttributes")


def short_name(name: Column, prefix: str = "nc") -> Column:
    """A component's name in lower case, without spaces and the family's prefix."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\s+", ""), f"^{prefix}-?", "")


def documented_by(components: DataFrame, documents: DataFrame, prefix: str = "nc") -> DataFrame:
    """(component, document) for components (component) and documents (document, title, ordinal): the first document whose name has the component's, or is part of it."""
    own = components.select("component", short_name(F.col("component"), prefix).alias("_short")).filter("_short <> ''")
    pages = documents.select(short_name(F.col("title"), prefix).alias("_title"), "document", "ordinal")
    first = pages.groupBy("_title").agg(F.min(F.struct("ordinal", "document")).alias("_d")).select("_title", F.col("_d.document").alias("document"), F.col("_d.ordinal").alias("ordinal"))
    return joins.containment(own, "_short", first, "_title", "ordinal").join(first, "_title").select("component", "document")


def source_values(components: DataFrame, symbols: DataFrame, commit: Column) -> DataFrame:
    """Values that the sources give: public attributes, methods, events and slots.

    components: component, props, properties, methods (arrays of symbol ids), events, slots, lifecycle (arrays of names).
    symbols: id, name, path, type, signature, visibility, members (array of ids). A property model stands for its members.
    """
    none = F.array().cast("array<string>")
    rows = lambda c: components.select("component", "lifecycle", F.posexplode(F.coalesce(c, none)).alias("place", "id"))
    model = rows("props").join(symbols.select("id", "members"), "id", "left")
    props = model.select("component", "lifecycle", "place", F.posexplode(F.when(F.size(F.coalesce("members", none)) > 0, F.col("members")).otherwise(F.array("id"))).alias("_in", "id"))
    ids = props.unionByName(rows("properties").withColumns({"place": F.col("place") + 1_000_000, "_in": F.lit(0)})).groupBy("component", "id").agg(F.min(F.struct("place", "_in")).alias("_at"))
    public = symbols.filter(~F.coalesce("visibility", F.lit("public")).isin("private", "protected"))
    value = lambda df, kind, origin, type: df.select("component", F.lit(kind).alias("item_kind"), "name", origin.alias("source"), type.alias("type"), F.lit(None).cast("string").alias("default_value"), commit.alias("commit"), F.concat(F.lit("symbol:"), "id").alias("evidence"), "_order")
    place = lambda n, at: F.struct(F.lit(n).alias("k"), F.col(f"{at}").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    attributes = value(ids.join(public, "id").withColumn("_order", F.struct(F.lit(0).alias("k"), F.col("_at.place").cast("long").alias("a"), F.col("_at._in").cast("long").alias("b"))), "attribute", F.when(F.col("path").endswith("types.ts"), TYPES).otherwise(CODE), F.coalesce(F.col("type"), F.col("signature")))
    methods = rows("methods").join(public, "id").filter(~F.col("name").isin(*OWN_MEMBERS) & ~F.array_contains(F.coalesce("lifecycle", none), F.col("name")))
    methods = methods.join(attributes.select("component", "name").distinct(), ["component", "name"], "left_anti")
    methods = value(methods.withColumn("_order", place(1, "place")), "method", F.lit(CODE), F.col("signature"))
    listed = lambda c, kind, n: value(components.select("component", F.posexplode(F.coalesce(c, none)).alias("place", "name")).withColumns({"_order": place(n, "place"), "id": F.col("component")}), kind, F.lit(CODE), F.lit(None).cast("string"))
    return attributes.unionByName(methods).unionByName(listed("events", "event", 2)).unionByName(listed("slots", "slot", 3))


def keyed(values: DataFrame) -> DataFrame:
    return values.withColumn("item", F.when(F.col("item_kind") == "event", quality.item_key(F.col("name"), True)).otherwise(quality.item_key(F.col("name"))))


_ITEM = ["component", "item_kind", "item"]


def items(values: DataFrame, target: Column) -> DataFrame:
    """One row an item: name, type and default_value of its first value, sources and evidence in order, status, confidence."""
    rows = keyed(values)
    judged = quality.reconcile(rows, _ITEM, "source", "ordinal", "type", "default_value", "commit", target)
    one = F.struct("ordinal", "source", "evidence", "name", "type", "default_value", "commit")
    told = rows.groupBy(*_ITEM).agg(F.array_sort(F.collect_list(one)).alias("_v"))
    first = lambda f: F.get(F.col("_v"), F.lit(0))[f].alias(f)
    told = told.select(*_ITEM, first("name"), first("type"), first("default_value"), F.array_distinct(F.transform("_v", lambda x: x["source"])).alias("sources"), F.transform("_v", lambda x: x["evidence"]).alias("evidence"), "_v")
    return told.join(judged, _ITEM)


def conflicts(values: DataFrame, target: Column, documented: DataFrame | None = None) -> DataFrame:
    """component, item_kind, name, conflict, severity, source_a, source_b, evidence.

    Of values that differ: type, default or commit. documented: (component) with a document; for these, values that only
    one side has.
    """
    found = items(values, target)
    at = lambda n, f: F.get("_v", F.lit(n))[f]
    fresh = F.get(F.filter("_v", lambda x: x["commit"] == target), F.lit(0))
    second = lambda f: F.coalesce(fresh[f], at(0, f))
    case = lambda name, severity, b, evidence: F.struct(F.lit(name).alias("conflict"), F.lit(severity).alias("severity"), b.alias("source_b"), evidence.alias("_e"))
    two = F.size("_v") > 1
    cells = F.array_compact(F.array(F.when((F.col("n_types") > 1) & two, case("type-mismatch", "error", at(1, "source"), at(1, "evidence"))), F.when((F.col("n_defaults") > 1) & two, case("default-mismatch", "warning", at(1, "source"), at(1, "evidence"))), F.when(F.col("commit_mismatch"), case("commit-mismatch", "error", second("source"), second("evidence")))))
    out = found.select("component", "item_kind", "name", at(0, "source").alias("source_a"), at(0, "evidence").alias("_a"), F.explode(cells).alias("_c"))
    out = out.select("component", "item_kind", "name", "_c.conflict", "_c.severity", "source_a", "_c.source_b", F.array("_a", "_c._e").alias("evidence"))
    if documented is None:
        return out
    rows = keyed(values).join(documented.select("component").distinct(), "component", "left_semi")
    doc, code = rows.filter(F.col("source") == DOC), rows.filter(F.col("source") != DOC)
    lone = lambda a, b, name, severity, other: a.join(b.select(*_ITEM).distinct(), _ITEM, "left_anti").select("component", "item_kind", "name", F.lit(name).alias("conflict"), F.lit(severity).alias("severity"), F.col("source").alias("source_a"), F.lit(other).alias("source_b"), F.array("evidence").alias("evidence"))
    return out.unionByName(lone(code, doc, "source-public-item-not-documented", "warning", DOC)).unionByName(lone(doc, code, "documented-item-not-found-in-source", "error", CODE))


def coverage(values: DataFrame, found: DataFrame, examples: DataFrame) -> DataFrame:
    """A row a component of values: how many documented attributes, events, methods and slots, its examples (component), conflicts and sections that lack, and complete, partial or empty."""
    doc = values.filter(F.col("source") == DOC)
    counts = values.select("component").distinct().join(doc.groupBy("component").agg(*(F.count_if(F.col("item_kind") == k).alias(f"n_{k}s") for k in ("attribute", "event", "method", "slot"))), "component", "left")
    n = lambda df, name: df.groupBy("component").agg(F.count("*").alias(name))
    out = counts.join(n(examples, "n_examples"), "component", "left").join(n(found, "n_conflicts"), "component", "left").na.fill(0)
    names = {"attributes": "n_attributes", "events": "n_events", "methods": "n_methods", "slots": "n_slots", "examples": "n_examples"}
    missing = F.array_compact(F.array(*(F.when(F.col(c) == 0, s) for s, c in names.items())))
    api = sum((F.col(c) for c in ("n_attributes", "n_events", "n_methods", "n_slots")), F.lit(0))
    return out.withColumns({"missing": missing, "status": F.when(api == 0, "empty").when(F.size(missing) == 0, "complete").otherwise("partial")})
