"""Component pages: tables to API rows, and TypeScript sources to declarations, imports and exports by syntax alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.markup import html_headings, html_tables, lines_of
from lodeworks.operators.classify import cascade
from lodeworks.operators.sequence import forward_fill

# Headings of an API page, in two languages.
SECTIONS = (("attributes", r"(?i)attribute|\bprops?\b|properties|属性|参数"), ("events", "(?i)event|事件"), ("methods", "(?i)method|方法|expose"), ("slots", "(?i)slot|插槽"), ("examples", "(?i)example|demo|usage|示例|用法"))
CELLS = {"name": r"(?i)name|名称|属性名|事件名|方法名|参数", "description": "(?i)desc|说明|描述", "type": "(?i)type|类型", "default": "(?i)default|默认", "required": "(?i)required|必填"}
EMPTY = ("", "-", "—", "--", "/", "none", "null", "n/a")


def section_of(heading: Column) -> Column:
    """The canonical name of a heading, null if it is none of an API page's."""
    return cascade(*((heading.rlike(p), name) for name, p in SECTIONS))


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, heading, line_no, header, cells: body rows of Markdown tables below the last heading and their header row."""
    lines = forward_fill(lines_of(docs, key, text), [key], ["line_no"], F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), F.regexp_replace("line", r"^#+\s+|\s*#*\s*$", "")), "heading")
    split = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    rows = lines.withColumns({"is_row": F.col("line").rlike(r"^\s*\|.*\|\s*$"), "is_rule": F.col("line").rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")})
    rows = rows.withColumn("cells", F.when(F.col("is_row") & ~F.col("is_rule"), split))
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("line_no")
    rows = rows.withColumns({"_head": F.when(F.lead("is_rule").over(w) & F.col("is_row"), F.col("cells")), "_stop": ~F.col("is_row") & ~F.col("is_rule")})
    # The header row holds until a line outside the table.
    mark = F.when(F.col("_stop"), F.array(F.lit("\0"))).otherwise(F.col("_head"))
    rows = forward_fill(rows, [key], ["line_no"], mark, "header")
    return rows.filter(F.col("cells").isNotNull() & F.col("_head").isNull() & F.col("header").isNotNull() & (F.get("header", F.lit(0)) != "\0")).select(key, "heading", "line_no", "header", "cells")


def tables_of_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, heading, line_no, header, cells of HTML tables; a table's heading is the last one before it."""
    rows = html_tables(pages, key, html)
    heads = rows.filter("row_no = 0").select(key, "table_no", F.col("cells").alias("header"))
    parts = pages.select(key, F.posexplode(F.split(F.col(html), "(?i)<table")).alias("table_no", "before"))
    last = html_headings(parts.withColumn("_k", F.struct(key, "table_no")), "_k", "before").groupBy("_k").agg(F.max_by("heading", "ordinal").alias("heading")).select(F.col(f"_k.{key}").alias(key), F.col("_k.table_no").alias("table_no"), "heading")
    out = rows.filter("row_no > 0").join(heads, [key, "table_no"]).join(last, [key, "table_no"], "left")
    return out.select(key, "heading", (F.col("table_no") * 1000 + F.col("row_no")).cast("long").alias("line_no"), "header", "cells")


def _cell(pattern: str) -> Column:
    at = F.array_position(F.transform("header", lambda h: h.rlike(pattern)), True)
    value = F.trim(F.regexp_replace(F.get("cells", (at - 1).cast("int")), "`", ""))
    return F.when((at > 0) & ~F.lower(value).isin(*EMPTY), value)


def api_rows(tables: DataFrame, key: str) -> DataFrame:
    """key, section, name, type, default_value, required, description: the API that a page's tables list.

    Attributes whose type is a slot count as slots; rows without a name are left out.
    """
    rows = tables.withColumn("section", section_of(F.col("heading"))).filter("section is not null")
    rows = rows.select(key, "line_no", "section", F.coalesce(_cell(CELLS["name"]), F.get("cells", F.lit(0))).alias("name"), _cell(CELLS["type"]).alias("type"), _cell(CELLS["default"]).alias("default_value"), _cell(CELLS["required"]).alias("_r"), _cell(CELLS["description"]).alias("description"))
    moved = F.when((F.col("section") == "attributes") & F.lower(F.col("type")).contains("slot"), "slots").otherwise(F.col("section"))
    required = F.when(F.col("_r").isNotNull(), F.col("_r").rlike("(?i)^(true|yes|y|是)$"))
    return rows.filter(F.length("name") > 0).select(key, "line_no", moved.alias("section"), "name", "type", "default_value", required.alias("required"), "description")


# Declarations at the start of a statement. Fixed forms of the language.
_DECLARES = r"^(export\s+)?(default\s+)?(declare\s+)?(abstract\s+)?(async\s+)?(const enum|class|interface|enum|function|type|const|let|var|namespace)\b\s*\*?\s*([A-Za-z_$][\w$]*)?"
_ASSIGNED = r"^export\s+(?:default\s+(?!class\b|function\b|abstract\s+class\b|async\s+function\b|interface\b|enum\b)|=\s*)(.+)$"
_REQUIRED = r"^import\s+(type\s+)?([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
_IMPORTS = r"^import\s+(type\s+)?(.*?)\s*from\s*['\"]([^'\"]+)['\"]"
_BARE = r"^import\s*['\"]([^'\"]+)['\"]"
_REEXPORTS = r"^export\s+(type\s+)?(\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]"
_NAMED = r"^export\s+(type\s+)?\{([^}]*)\}\s*;?\s*$"


def _statements(files: DataFrame) -> DataFrame:
    """path, line, code, inside: the statements of a file's top level in one line each, and its dynamic imports."""
    from lodeworks.functions.syntax import file_statements

    return file_statements(files).filter("scope is null").select("path", "line", F.col("head").alias("code"), "inside")


def declarations(files: DataFrame) -> DataFrame:
    """path, line, kind, name, exported, is_default of top-level TypeScript declarations in (path, text). By syntax only: types aren't resolved."""
    return _declared(_statements(files))


def _kind_and_name() -> tuple[Column, Column]:
    at = lambda g: F.regexp_extract("code", _DECLARES, g)
    kind = F.when(at(6).isin("const", "let", "var"), "variable").when(at(6) == "const enum", "enum").otherwise(at(6))
    return kind, F.when((at(7) == "") | (at(6) == "class") & at(7).isin("extends", "implements"), "anonymous").otherwise(at(7))


def _declared(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("inside").isNull() & F.col("code").rlike(_DECLARES))
    at = lambda g: F.regexp_extract("code", _DECLARES, g)
    kind, name = _kind_and_name()
    return rows.select("path", "line", kind.alias("kind"), name.alias("name"), (at(1) != "").alias("exported"), (at(2) != "").alias("is_default"))


def _names(listed: Column) -> Column:
    """(local, outer) of the entries of a brace list."""
    entries = F.filter(F.transform(F.split(F.regexp_replace(listed, r"[{}]", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"^\s*type\s+", ""))), lambda x: x != "")
    return F.transform(entries, lambda x: F.struct(F.trim(F.split(x, r"\s+as\s+")[0]).alias("first"), F.trim(F.element_at(F.split(x, r"\s+as\s+"), -1)).alias("last")))


def _each(rows: DataFrame, names: str, *cells: tuple[Column, Column]) -> DataFrame:
    """path, line and what the cells (condition, array of structs of the named fields) whose condition holds have, in one pass over the rows."""
    none = F.array().cast(f"array<struct<{names}>>")
    rows = rows.select("path", "line", F.explode(F.concat(*(F.when(holds, made.cast(f"array<struct<{names}>>")).otherwise(none) for holds, made in cells))).alias("_r"))
    return rows.select("path", "line", "_r.*")


def imports(files: DataFrame) -> DataFrame:
    """path, line, source, imported, local, type_only. * is a namespace or, without a local name, a dynamic import; a bare import has no names."""
    c, top, no = F.col("code"), F.col("inside").isNull(), F.lit(None).cast("string")
    row = lambda *cells: F.struct(*(x.alias(n) for x, n in zip(cells, ("source", "imported", "local", "type_only"), strict=True)))
    at = lambda p, g: F.regexp_extract(c, p, g)
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    none = F.array().cast("array<struct<first:string,last:string>>")
    what = at(_IMPORTS, 2)
    space, default = F.regexp_extract(what, r"\*\s+as\s+([\w$]+)", 1), F.regexp_extract(what, r"^([A-Za-z_$][\w$]*)", 1)
    items = F.concat(F.when(default != "", F.array(pair(F.lit("default"), default))).otherwise(none), F.when(space != "", F.array(pair(F.lit("*"), space))).otherwise(none), _names(F.regexp_extract(what, r"(\{[^}]*\})", 1)))
    return _each(
        _statements(files).filter((F.col("inside") == "import") | top & c.startswith("import")), "source:string,imported:string,local:string,type_only:boolean",
        (top & c.rlike(_IMPORTS), F.transform(items, lambda i: row(at(_IMPORTS, 3), i["first"], i["last"], at(_IMPORTS, 1) != ""))),
        (top & c.rlike(_BARE), F.array(row(at(_BARE, 1), no, no, F.lit(False)))),
        (top & c.rlike(_REQUIRED), F.array(row(at(_REQUIRED, 3), F.lit("*"), at(_REQUIRED, 2), at(_REQUIRED, 1) != ""))),
        (F.col("inside") == "import", F.array(row(c, F.lit("*"), no, F.lit(False)))),
    )


def exports(files: DataFrame) -> DataFrame:
    """path, line, exported, local, source (null without one), type_only, re_export. A star export has * as its name."""
    c, no, not_again = F.col("code"), F.lit(None).cast("string"), F.lit(False)
    row = lambda *cells: F.struct(*(x.alias(n) for x, n in zip(cells, ("exported", "local", "source", "type_only", "re_export"), strict=True)))
    at = lambda p, g: F.regexp_extract(c, p, g)
    what = at(_REEXPORTS, 2)
    alias = F.regexp_extract(what, r"^\*\s+as\s+([\w$]+)", 1)
    star = F.array(F.struct(F.lit("*").alias("first"), F.when(alias != "", alias).otherwise("*").alias("last")))
    again = F.transform(F.when(what.startswith("*"), star).otherwise(_names(what)), lambda i: row(i["last"], i["first"], at(_REEXPORTS, 3), at(_REEXPORTS, 1) != "", F.lit(True)))
    kind, name = _kind_and_name()
    own = row(F.when(at(_DECLARES, 2) != "", "default").otherwise(name), name, no, kind.isin("interface", "type"), not_again)
    return _each(
        _statements(files).filter(F.col("inside").isNull() & c.startswith("export")), "exported:string,local:string,source:string,type_only:boolean,re_export:boolean",
        (c.rlike(_REEXPORTS), again),
        (c.rlike(_NAMED), F.transform(_names(at(_NAMED, 2)), lambda i: row(i["last"], i["first"], no, at(_NAMED, 1) != "", not_again))),
        (c.rlike(_DECLARES), F.array(own)),
        (c.rlike(_ASSIGNED), F.array(row(F.lit("default"), at(_ASSIGNED, 1), no, not_again, not_again))),
    )


def module_candidates(path: Column, source: Column) -> Column:
    """Paths that a relative import may mean, in order of preference; none for a package name."""
    parts = F.split(F.concat_ws("/", F.regexp_extract(path, r"^(.*)/[^/]*$", 1), source), "/")
    up = lambda have: F.when((F.size(have) > 0) & (F.coalesce(F.try_element_at(have, F.lit(-1)), F.lit("..")) != ".."), F.slice(have, 1, F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(F.lit(".."))))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda have, x: F.when(x.isin("", "."), have).when(x == "..", up(have)).otherwise(F.concat(have, F.array(x)))), "/")
    stem = F.regexp_replace(joined, r"\.js$", "")
    forms = F.array(joined, F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(joined, F.lit("/index.ts")), F.concat(joined, F.lit("/index.tsx")), F.concat(stem, F.lit(".d.ts")))
    return F.when(source.startswith("."), forms).otherwise(F.array().cast("array<string>"))


def resolve_exports(exported: DataFrame, modules: DataFrame, depth: int | None = None) -> DataFrame:
    """path, exported, origin, local, hops: where each exported name of a module is declared, through re-exports.

    exported: exports(); modules: (path, source, resolved), each module's relative sources and what they are. A name is
    followed to its end, or for depth steps if given, and never through a module twice; of several ways the shortest stays.
    """
    from lodeworks.sources.snapshots import cut

    edges = cut(exported.filter("re_export").join(modules, ["path", "source"]).select(F.col("path").alias("m"), F.col("exported").alias("out"), F.col("local").alias("into"), "resolved"))
    own = cut(exported.filter("source is null").select(F.col("path").alias("m"), F.col("exported").alias("out"), "local"))
    found = own.select(F.col("m").alias("path"), F.col("out").alias("exported"), F.col("m").alias("origin"), "local", F.lit(0).alias("hops"), F.array("m").alias("way"))
    out, now, d = found, found, 0
    while depth is None or d < depth:
        d += 1
        e, n = edges.alias("e"), now.alias("n")
        step = e.join(n, (F.col("e.resolved") == F.col("n.path")) & ((F.col("e.into") == F.col("n.exported")) | ((F.col("e.into") == "*") & (F.col("e.out") == "*") & (F.col("n.exported") != "default"))) & ~F.array_contains(F.col("n.way"), F.col("e.m")))
        name = F.when(F.col("e.out") == "*", F.col("n.exported")).otherwise(F.col("e.out"))
        now = cut(step.select(F.col("e.m").alias("path"), name.alias("exported"), "n.origin", "n.local", F.lit(d).alias("hops"), F.concat(F.array(F.col("e.m")), F.col("n.way")).alias("way")))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    best = out.groupBy("path", "exported").agg(F.min(F.struct("hops", "origin", "local", "way")).alias("b"))
    return best.select("path", "exported", "b.origin", "b.local", "b.hops", F.array_join("b.way", ">").alias("chain"))
