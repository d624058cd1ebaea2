"""Edges between symbols, components with what belongs to them, and workspace membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.hashing import composite_id
from lodeworks.functions.paths import basename, dirname, glob_regex, matches_any


def edge_rows(df: DataFrame, kind: str, src: Column, dst: Column, evidence: Column | None = None, confidence: str = "high") -> DataFrame:
    """The edges entity: id, type, src, dst, evidence_path, confidence; each edge once."""
    rows = df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence_path"))
    once = rows.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("evidence_path").alias("evidence_path"))
    return once.select(composite_id("relation", F.lit(kind), F.col("src"), F.col("dst")).alias("id"), F.lit(kind).alias("type"), "src", "dst", "evidence_path", F.lit(confidence).alias("confidence"))


def _named(symbols: DataFrame) -> DataFrame:
    """Names that one top-level symbol has, with its path."""
    return symbols.filter("owner is null").groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("target")).filter("n = 1").select(F.col("name").alias("_name"), "target")


def heritage_edges(symbols: DataFrame) -> DataFrame:
    """From a class or interface to each base that one symbol is called."""
    bases = symbols.select("path", "name", F.explode("heritage").alias("_h")).select("path", "name", F.regexp_extract("_h", r"^([A-Za-z_$][\w$]*)", 1).alias("_name"))
    hit = bases.join(_named(symbols), "_name")
    return edge_rows(hit, "extends", F.concat_ws("#", "path", "name"), F.concat_ws("#", "target", "_name"), F.col("path"))


def reference_edges(symbols: DataFrame) -> DataFrame:
    """From a symbol to each other one that its signature names, if only one has that name."""
    words = symbols.select("path", "qualified_name", "name", "owner", F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit(r"\b([A-Z][\w$]*)"), 1))).alias("_name")).filter("_name <> name and not (_name <=> owner)")
    return edge_rows(words.join(_named(symbols), "_name"), "references", F.concat_ws("#", "path", "qualified_name"), F.concat_ws("#", "target", "_name"), F.col("path"), "medium")


def import_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """From a module to each that it imports; modules: (path, source, resolved)."""
    return edge_rows(imports.join(modules, ["path", "source"]), "imports", F.col("path"), F.col("resolved"), F.col("path"))


def components(symbols: DataFrame, source_globs: list[str], base_types: list[str], public_paths: DataFrame, prefix: str = "") -> DataFrame:
    """Classes below the globs that extend a base type: path, name, bases, methods, properties, props, reasons, confidence, status.

    public_paths: (path) of publicly reachable modules. props: the class or interface of the folder called <name>Props.
    """
    bases = F.transform("heritage", lambda h: F.trim(F.regexp_replace(h, "<.*$", "")))
    found = symbols.filter((F.col("kind") == "class") & matches_any(F.col("path"), source_globs, "symbols")).withColumn("bases", bases)
    found = found.filter(F.arrays_overlap("bases", F.array(*map(F.lit, base_types)))).select("path", "name", "bases", F.regexp_replace("name", f"^{prefix}", "").alias("_short"))
    parts = symbols.filter("owner is not null and visibility = 'public'").groupBy("path", F.col("owner").alias("name")).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind").isin("method", "getter", "setter"), F.col("qualified_name")))).alias("methods"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "property", F.col("qualified_name")))).alias("properties"))
    props = symbols.filter("owner is null and name like '%Props'").select(dirname(F.col("path")).alias("_dir"), F.regexp_replace("name", "Props$", "").alias("_short"), F.col("name").alias("props")).dropDuplicates(["_dir", "_short"])
    out = found.join(parts, ["path", "name"], "left").withColumn("_dir", dirname(F.col("path"))).join(props, ["_dir", "_short"], "left")
    out = out.join(public_paths.select("path").distinct().withColumn("_public", F.lit(True)), "path", "left")
    none = F.array().cast("array<string>")
    reasons = F.array_compact(F.array(F.lit("source path"), F.lit("base type"), F.when(F.col("_public"), "public"), F.when(F.col("props").isNotNull(), "props")))
    return out.select("path", "name", "bases", F.coalesce("methods", none).alias("methods"), F.coalesce("properties", none).alias("properties"), "props", reasons.alias("reasons"),
                      F.when(F.size(reasons) >= 4, "high").otherwise("medium").alias("confidence"), F.when(F.col("_public"), "public").otherwise("internal").alias("status"))


def attachments(parts: DataFrame, files: DataFrame, templates: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """(path, name, kind, file): files that a component's templates name; {dir}, {basename} and {component} stand for its own.

    Templates without wildcards meet files by equality; others by their longest segment without one, or else by what ends
    their last one (an extension), then by pattern. Only a template that has neither is held against all files.
    """
    rows = None
    for kind, own in templates.items():
        one = parts.select("path", "name", F.lit(kind).alias("kind"), F.explode(F.array(*map(F.lit, own))).alias("t"))
        rows = one if rows is None else rows.unionByName(one)
    folder = dirname(F.col("path"))
    values = {"{dir}": folder, "{basename}": basename(folder), "{component}": F.lower(F.regexp_replace("name", f"^{prefix}", ""))}
    t = F.col("t")
    for mark, value in values.items():
        t = F.replace(t, F.lit(mark), value)
    plain = F.filter(F.split(t, "/"), lambda x: ~x.rlike("[*?]") & (x != ""))
    longest = F.array_max(F.transform(plain, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    ending = F.regexp_extract(t, r"(\.[^*?/.]+)$", 1)
    rows = rows.withColumn("t", t).withColumn("_stem", F.coalesce(F.concat(F.lit("/"), longest), ending))
    every = files.select(F.col("path").alias("file")).distinct()
    exact = rows.filter(~F.col("t").rlike("[*?]")).join(every, F.col("t") == F.col("file"))
    keys = F.array_distinct(F.concat(F.transform(F.split("file", "/"), lambda x: F.concat(F.lit("/"), x)), F.array(F.regexp_extract("file", r"(\.[^*?/.]+)$", 1), F.lit(""))))
    asked = rows.filter(F.col("t").rlike("[*?]"))
    placed = every.select("file", F.explode(keys).alias("_stem")).join(asked.select("_stem").distinct(), "_stem", "left_semi")
    loose = asked.join(placed, "_stem").filter(F.rlike(F.col("file"), glob_regex(F.col("t"))))
    return exact.select("path", "name", "kind", "file").unionByName(loose.select("path", "name", "kind", "file")).distinct()


def workspace_members(manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, directory): package directories that a workspace's patterns hold; a pattern after ! takes out.

    roots: (root, patterns array); manifests: (root, directory).
    """
    rows = manifests.join(roots, "root")
    fits = lambda p: F.rlike(F.col("directory"), glob_regex(F.regexp_replace(p, "^!|/$", "")))
    inside = F.exists("patterns", lambda p: ~p.startswith("!") & fits(p)) & ~F.exists("patterns", lambda p: p.startswith("!") & fits(p))
    return rows.filter(inside).select("root", "directory")


def symbol_statistics(symbols: DataFrame, imports: DataFrame, exports: DataFrame, parts: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(measure, key, n): how many symbols, by kind and otherwise, imports, exports and components there are, and the largest modules.

    imports: path, source, resolved (null: unresolved); exports: as apidoc.exports() gives them; parts: components with
    confidence, and arrays of styles, examples, documents, props, events and slots. Measures with keys have a row for each.
    """
    from lodeworks.sources.snapshots import cut

    none = F.lit(None).cast("string")
    one = lambda df, cells: df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in cells.items())).select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), none.alias("key"), F.col(n).alias("n")) for n in cells))).alias("x")).select("x.*")
    # Each table is read once, into counts by what the measures ask for.
    few = symbols.groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_if("exported").alias("exported"), F.count_if(F.col("owner").isNotNull()).alias("members"), F.count_if("deprecated").alias("deprecated"), F.count_if(F.col("visibility") != "public").alias("hidden"))
    few, outward = cut(few), cut(exports.groupBy("exported", "re_export").agg(F.count("*").alias("n")))
    per = lambda df, name, key: df.groupBy(key.cast("string").alias("key")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    top = lambda df, name, key: per(df, name, key).orderBy(F.col("n").desc(), "key").limit(most)
    out = one(few, {"modules": F.count_distinct("path"), "declarations": F.sum("n"), "exported_symbols": F.sum("exported"), "members": F.sum("members"), "deprecated": F.sum("deprecated"), "private_members": F.sum("hidden")})
    out = out.unionByName(per(few, "symbols_by_kind", F.col("kind"))).unionByName(top(few, "largest_modules", F.col("path")))
    out = out.unionByName(one(imports, {"imports": F.count("*"), "unresolved_imports": F.count_if(F.col("resolved").isNull()), "type_only_imports": F.count_if("type_only")}))
    out = out.unionByName(one(outward, {"exports": F.sum("n"), "re_exports": F.sum(F.when(F.col("re_export"), F.col("n"))), "default_exports": F.sum(F.when(F.col("exported") == "default", F.col("n")))})).unionByName(top(outward.filter("re_export"), "most_re_exported", F.col("exported")))
    if parts is not None:
        some = lambda c: F.count_if(F.size(c) > 0)
        sizes = lambda c: F.sum(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))))
        out = out.unionByName(per(parts.withColumn("n", F.lit(1)), "components_by_confidence", F.col("confidence"))).unionByName(one(parts, {"components": F.count("*"), "components_with_styles": some("styles"), "components_with_examples": some("examples"), "components_with_documents": some("documents"), "props": sizes("props"), "events": sizes("events"), "slots": sizes("slots")}))
    return out
