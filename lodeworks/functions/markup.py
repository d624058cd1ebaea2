"""Structure of HTML and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions.text import anchor


def html_strip(html: Column) -> Column:
    """Text without scripts, styles and tags; four entities decoded, white space collapsed."""
    s = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\r\n\f]+", " "))


def html_title(html: Column) -> Column:
    return html_strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, level, heading."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<h([1-6])[^>]*>.*?</h\2>)"), 1)
    rows = pages.select(key, F.posexplode(found).alias("ordinal", "tag"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.regexp_extract("tag", r"(?i)^<h([1-6])", 1).cast("long").alias("level"), html_strip(F.col("tag")).alias("heading"))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, target, text."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), 1)
    rows = pages.select(key, F.posexplode(found).alias("ordinal", "tag"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.regexp_extract("tag", r"(?i)href=\"([^\"]*)\"", 1).alias("target"), html_strip(F.col("tag")).alias("text"))


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, cells (array of strings): the cells of every table row."""
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<table[^>]*>.*?</table>)"), 1)).alias("table_no", "t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)(<tr[^>]*>.*?</tr>)"), 1)).alias("row_no", "r"))
    return rows.select(key, "table_no", "row_no", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), html_strip).alias("cells"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    own = F.split(F.regexp_replace(F.col(text), "\r\n|\r", "\n"), "\n")
    return docs.select(key, F.posexplode(own).alias("i", "line")).select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")


def fence_state(lines: DataFrame, key: str, fence: Column | None = None) -> DataFrame:
    """lines with is_fence and in_fence; a fence that is never closed runs to the end. fence: what marks one, ``` by default."""
    mark = F.col("line").rlike(r"^\s*```") if fence is None else fence
    upto = F.sum(F.col("is_fence").cast("long")).over(W.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("is_fence", mark).withColumn("in_fence", ~F.col("is_fence") & (upto % 2 == 1))


def section_tree(headings: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """Sections from (key, line_no, level, heading) and each document's (key, last_line).

    A section ends before the next heading of its own or a smaller level; its parent is the nearest earlier heading of a
    smaller level. Levels are 1 to 6, so both are running window values, one for each level.
    """
    w = W.partitionBy(key).orderBy("line_no")
    after, before = w.rowsBetween(1, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, -1)
    nexts = [F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(after) for k in range(1, 7)]
    ups = [F.max(F.when(F.col("level") < k, F.col("line_no"))).over(before) for k in range(1, 7)]
    pick = lambda options: F.element_at(F.array(*options), F.col("level").cast("int"))
    out = headings.withColumns({"next_line": pick(nexts), "parent_line": pick(ups)}).join(ends, key)
    return out.select(key, "line_no", "level", "heading", F.coalesce(F.col("next_line") - 1, F.greatest("last_line", "line_no")).alias("line_end"), "parent_line", anchor(F.col("heading")).alias("anchor"))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The section tree of Markdown texts, blind to headings in fences."""
    lines = fence_state(lines_of(docs, key, text), key)
    pattern = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    heads = lines.filter(~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(pattern))
    heads = heads.select(key, "line_no", F.length(F.regexp_extract("line", pattern, 1)).cast("long").alias("level"), F.regexp_extract("line", pattern, 2).alias("heading"))
    return section_tree(heads, key, lines.groupBy(key).agg(F.max("line_no").alias("last_line")))


def markdown_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, text, target, external, of links outside fences."""
    lines = fence_state(lines_of(docs, key, text), key).filter(~F.col("is_fence") & ~F.col("in_fence"))
    pattern = r"\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
    rows = lines.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(f"({pattern})"), 1)).alias("link"))
    target = F.regexp_extract("link", pattern, 2)
    return rows.select(key, "line_no", F.regexp_extract("link", pattern, 1).alias("text"), target.alias("target"), target.rlike("^(?:https?:|mailto:|#)").alias("external"))


def markdown_code_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (of the opening fence), language and code of the fenced blocks; one that isn't closed goes to the end."""
    lines = fence_state(lines_of(docs, key, text), key)
    opens = F.col("is_fence") & (F.sum(F.col("is_fence").cast("long")).over(W.partitionBy(key).orderBy("line_no")) % 2 == 1)
    rows = lines.withColumn("_open", opens).withColumn("_block", F.count_if("_open").over(W.partitionBy(key).orderBy("line_no")))
    rows = rows.filter((F.col("_block") > 0) & (F.col("_open") | F.col("in_fence")))
    out = rows.groupBy(key, "_block").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("_open"), F.regexp_extract("line", r"^\s*(?:`{3,}|~{3,})\s*([\w+#-]*)", 1))).alias("language"),
                                          F.array_sort(F.collect_list(F.when(F.col("in_fence"), F.struct("line_no", "line")))).alias("_l"))
    return out.select(key, "line_no", F.nullif("language", F.lit("")).alias("language"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("code"))


def html_code_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, ordinal, language and code of the <pre> elements, without markup and with the common references decoded."""
    pattern = r"(?is)<pre\b[^>]*>(.*?)</pre>"
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), 1)).alias("ordinal", "_b"))
    code = F.regexp_replace("_b", "(?s)<[^>]*>", "")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        code = F.replace(code, F.lit(f"&{name};"), F.lit(sign))
    return rows.select(key, "ordinal", F.nullif(F.regexp_extract("_b", r"(?i)class\s*=\s*[\"'][^\"']*\blanguage-([\w+#-]+)", 1), F.lit("")).alias("language"), code.alias("code"))


def markdown_title(text: Column) -> Column:
    """The first heading of the first level."""
    return F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*#*\s*$", 1), F.lit(""))
