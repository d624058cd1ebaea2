"""TypeScript sources to symbol records: declarations, members, signatures, parameters, heritage and doc comments.

By syntax alone. lexer.py cuts a file into statements, those in the bodies of classes, interfaces, enums and namespaces
among them, each file in a task of its own; what a statement declares is read off its head by column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.lexer import statements
from lodeworks.operators.classify import cascade
from lodeworks.tables import dealt

_STATEMENT = "path string, line int, end_line int, head string, left string, inside string, scope string, doc string, params array<string>, after string"
_KINDS = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string()]
_MODIFIERS = r"((?:(?:export|default|declare|abstract|public|private|protected|static|readonly|async|override|accessor)\s+)*)"
_NAME = r"([\w$#]+|\[[^\]]*\]|\"[^\"]*\"|'[^']*')"
# Forms of the language.
_TOP = rf"^{_MODIFIERS}(const enum|class|interface|enum|function|type|const|let|var|namespace|module|global)\b\s*\*?\s*([\w$.]+|\{{[^=]*\}}|\[[^=]*\]|\"[^\"]*\"|'[^']*')?"
_ACCESSOR = rf"^{_MODIFIERS}(get|set)\s+{_NAME}\s*\("
_METHOD = rf"^{_MODIFIERS}\*?\s*{_NAME}(\??)\s*(?:<.*?>)?\("
_PROPERTY = rf"^{_MODIFIERS}{_NAME}([?!]?)\s*(?::\s*(.+))?$"
_PARAMETER = r"^(?:(?:public|private|protected|readonly|override)\s+)*(\.\.\.)?\s*([\w$]+|\{.*?\}|\[.*?\])(\?)?\s*(?::\s*(.+?))?(\s*=(?!>).*)?$"


def _read(batches):
    for batch in batches:
        for path, text in zip(*(batch.column(i) for i in (0, 1)), strict=True):
            rows = statements(text.as_py())
            columns = [[path.as_py()] * len(rows), *([r[k] for r in rows] for k in range(9))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in _STATEMENT.split(", ")])


def file_statements(files: DataFrame) -> DataFrame:
    """The statements of (path, text), as lexer.statements() says. Null texts have none."""
    return dealt(files.select(F.col("path").cast("string"), F.col("text").cast("string")), "path").mapInArrow(_read, _STATEMENT)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def doc_parts(doc: Column) -> list[Column]:
    """summary, tags, deprecated and examples of a comment that starts with two stars."""
    body = F.regexp_replace(F.regexp_extract(doc, r"(?s)/\*\*(.*?)\*/", 1), r"(?m)^[ \t]*\*[ \t]?", "")
    tags = F.coalesce(F.regexp_extract_all(body, F.lit(r"@([A-Za-z][\w-]*)"), 1), F.array().cast("array<string>"))
    summary = F.nullif(_one_line(F.regexp_replace(body, r"(?s)(?:^|\n)\s*@.*$", "")), F.lit(""))
    examples = F.transform(F.coalesce(F.regexp_extract_all(body, F.lit(r"@example\s+([^@]+)"), 1), F.array().cast("array<string>")), _one_line)
    return [summary.alias("summary"), tags.alias("tags"), F.array_contains(tags, "deprecated").alias("deprecated"), examples.alias("examples")]


def heritage_of(head: Column) -> Column:
    """The types after extends and implements, split at commas outside angle brackets, braces and round ones; head: of a class or interface, type parameters cut off."""
    clauses = F.regexp_extract_all(head, F.lit(r"\b(?:extends|implements)\s+(.+?)(?=\s+implements\b|$)"), 1)
    return F.filter(F.transform(F.flatten(F.transform(clauses, lambda c: F.split(c, r",(?![^<]*>)(?![^{]*\})(?![^(]*\))"))), lambda x: F.trim(x)), lambda x: x != "")


def symbols(files: DataFrame) -> DataFrame:
    """The symbol records of (path, text): path, line, end_line, kind, name, owner, qualified_name, exported, is_default,
    visibility, explicit_visibility, modifiers, optional, type, signature, type_parameters, parameters, return_type,
    heritage, and what the doc comment above says.

    Members are those of classes, interfaces and enums; what namespaces hold is named by their names; overloads, and
    variables that are declared together, are rows of their own. Declarations within functions are none.
    """
    at = lambda p, g: F.regexp_extract("left", p, g)
    member = F.col("inside").isin("class", "interface", "enum")
    rows = file_statements(files).filter("inside is null or inside <> 'import'").withColumn("_member", F.coalesce(member, F.lit(False)))
    keyword = at(_TOP, 2)
    names = {"const": "variable", "let": "variable", "var": "variable", "type": "type_alias", "module": "namespace", "global": "namespace", "const enum": "enum"}
    top_kind = F.when(keyword != "", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), keyword), keyword))
    of = cascade((F.col("inside") == "enum", "enum_member"), (F.col("left").isin("static", ""), None), (F.col("left").rlike(rf"^{_MODIFIERS}\[\s*[\w$]+\s*:"), "index_signature"), (F.col("left").rlike(r"^new\s*[(<]"), "construct_signature"), (F.col("left").rlike(r"^[(<]"), "call_signature"),
                 (F.col("left").rlike(rf"^{_MODIFIERS}constructor\s*\("), "constructor"), (F.col("left").rlike(_ACCESSOR) & (at(_ACCESSOR, 2) == "get"), "getter"), (F.col("left").rlike(_ACCESSOR), "setter"), (F.col("left").rlike(_METHOD), "method"), (F.col("left").rlike(_PROPERTY), "property"))
    rows = rows.withColumn("kind", F.when(F.col("_member"), of).otherwise(top_kind)).filter("kind is not null")
    kind, bare = F.col("kind"), lambda c: F.regexp_replace(c, r"^['\"]|['\"]$", "")
    top_name = F.when(keyword == "global", "global").when((at(_TOP, 3) == "") | (kind == "class") & at(_TOP, 3).isin("extends", "implements"), "anonymous").otherwise(bare(at(_TOP, 3)))
    name = cascade((~F.col("_member"), top_name), (kind.isin("getter", "setter"), bare(at(_ACCESSOR, 3))), (kind == "method", bare(at(_METHOD, 2))), (kind == "enum_member", bare(F.trim("left"))), (kind == "property", bare(at(_PROPERTY, 2))), (F.lit(True), kind))
    modifiers = F.filter(F.split(F.trim(at(rf"^{_MODIFIERS}", 1)), r"\s+"), lambda m: m != "")
    given = F.coalesce(*(F.when(F.array_contains("modifiers", v), v) for v in ("private", "protected", "public")))
    head = F.trim(F.regexp_replace("head", rf"^{_MODIFIERS}", ""))
    left = F.trim(F.regexp_replace("left", rf"^{_MODIFIERS}", ""))
    signature = F.when(kind == "enum", F.concat(F.lit("enum "), "name")).when(kind.isin("property", "variable"), F.regexp_replace(left, r"^([\w$#]+)!", "$1")).otherwise(head)
    # What stands before and behind the type parameters of a class or interface.
    generic = F.regexp_extract(head, r"^(?:class|interface|function|type)?\s*\*?\s*[\w$#]*\??\s*<((?:[^<>]|=>|<(?:[^<>]|=>|<(?:[^<>]|=>|<[^<>]*>)*>)*>)*)>", 1)
    without = F.when(generic != "", F.replace(head, F.concat(F.lit("<"), generic, F.lit(">")), F.lit(""))).otherwise(head)
    none = F.array().cast("array<string>")
    parameters = F.transform("params", lambda p: F.struct(F.regexp_extract(p, _PARAMETER, 2).alias("name"), F.nullif(F.trim(F.regexp_extract(p, _PARAMETER, 4)), F.lit("")).alias("type"),
                                                          ((F.regexp_extract(p, _PARAMETER, 3) != "") | (F.regexp_extract(p, _PARAMETER, 5) != "")).alias("optional"), (F.regexp_extract(p, _PARAMETER, 1) != "").alias("rest")))
    called = kind.isin("function", "method", "constructor", "getter", "setter", "call_signature", "construct_signature")
    typed = F.when(kind == "property", at(_PROPERTY, 4)).when(kind == "variable", F.regexp_extract(left, r"^\w+\s+[\w$]+!?\s*:\s*(.+)$", 1)).when(kind == "type_alias", F.regexp_extract("head", r"=\s*(.+)$", 1))
    rows = rows.withColumns({"name": name, "modifiers": modifiers})
    rows = rows.select("*", signature.alias("signature"), given.alias("_given"), F.nullif(F.trim(typed), F.lit("")).alias("type"), F.when(kind.isin("class", "interface"), heritage_of(without)).otherwise(none).alias("heritage"), *doc_parts(F.coalesce("doc", F.lit(""))),
                       F.when(generic != "", F.transform(F.split(generic, r",(?![^<]*>)(?![^{]*\})"), lambda x: F.trim(x))).otherwise(none).alias("type_parameters"),
                       F.when(called, F.coalesce(parameters, F.array().cast("array<struct<name:string,type:string,optional:boolean,rest:boolean>>"))).alias("parameters"),
                       F.when(kind.isin("function", "method", "getter", "call_signature", "construct_signature"), F.nullif(F.regexp_extract("after", r"^:\s*(.+)$", 1), F.lit(""))).alias("return_type"))
    optional = F.coalesce((at(_PROPERTY, 3) == "?") & (kind == "property") | (at(_METHOD, 3) == "?") & (kind == "method"), F.lit(False))
    return rows.select("path", "line", "end_line", "kind", "name", F.when(F.col("_member"), F.col("scope")).alias("owner"), F.concat_ws(".", "scope", "name").alias("qualified_name"),
                       (~F.col("_member") & F.array_contains("modifiers", "export")).alias("exported"), (~F.col("_member") & F.array_contains("modifiers", "default")).alias("is_default"),
                       F.coalesce("_given", F.when(~F.col("_member"), "package").otherwise("public")).alias("visibility"), F.col("_given").isNotNull().alias("explicit_visibility"), "modifiers", optional.alias("optional"), "type", "signature", "type_parameters", "parameters", "return_type", "heritage", "summary", "tags", "deprecated", "examples")
