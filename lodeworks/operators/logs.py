"""Build logs to error events.

A log is a sequence of lines. For each tool a grammar says which lines head a record and which lines below tell the
place, as patterns with named fields. All grammars are applied to all lines in one pass; only lines that some grammar
knows are shuffled, once, to put records together. What a failed step's logs give no record for yields one generic event.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions.hashing import fingerprint
from lodeworks.functions.paths import relativize

#: Columns that identify a log and its step.
CONTEXT = ["run_id", "step_id", "ordinal", "status", "allow_failure", "exit_code", "source_root", "lab_root"]
#: What patterns may name, besides those.
FIELDS = ["severity", "message", "file", "line", "col", "rule", "code", "plugin"]
CANDIDATE = [*CONTEXT, "parser", "priority", "tool", "category", *FIELDS, "raw_excerpt", "confidence", "log", "position"]
_LOG = ["run_id", "step_id", "ordinal", "log"]


@dataclass(frozen=True)
class Pattern:
    """A regular expression over a line, without the white space around it, and what its groups are.

    fixed: values of fields that the line doesn't spell out. pair: it is matched against the line and the next one.
    """

    regex: str
    groups: tuple[str, ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()
    pair: bool = False

    def fields(self) -> Column:
        """The fields of a line that the pattern matches, null for other lines."""
        text = F.concat_ws("\n", F.trim("line"), F.trim("next")) if self.pair else F.trim("line")
        found = {g: F.nullif(F.trim(F.regexp_extract(text, self.regex, i + 1)), F.lit("")) for i, g in enumerate(self.groups)}
        found |= {name: F.lit(value) for name, value in self.fixed}
        return F.when(text.rlike(self.regex), F.struct(*(found.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS)))


@dataclass(frozen=True)
class Grammar:
    """How a tool writes its errors.

    one_for: "head", a record is an event, which has its first place if there is one; "place", each place below a head is
    an event. needs_place: a head without a place is no event. once: of heads with one code in a log the first counts.
    """

    tool: str
    category: str
    priority: int
    heads: tuple[Pattern, ...]
    places: tuple[Pattern, ...] = ()
    one_for: str = "head"
    needs_place: bool = False
    once: bool = False
    confidence: str = "high"


# Parts of messages: a text in quotes, and what the type checker prints behind a place.
_QUOTED = r"[\"'][^\"']+[\"']"
_INSIDE = r"[\"']([^\"']+)[\"']"
_CHECKED = r"error\s+(TS\d+):\s*(.*)$"
_PATH = r"(?:file://)?((?:[A-Za-z]:[\\/]|\.{0,2}/)?[^:*?\"<>|()]*"
# The tools' output, as they document or print it. Names of the tools are fixed values.
GRAMMARS = {
    # A line with a file, then lines with line:column, a level, the text, and the rule behind two spaces.
    "eslint": Grammar("eslint", "lint", 100, (Pattern(r"^((?:[A-Za-z]:[\\/]|\.{0,2}/)[^:*?\"<>|]*\.(?:[cm]?[jt]sx?|vue))$", ("file",)),),
                      (Pattern(r"^(\d+):(\d+)\s+(error|warning)\s+(.*?)(?:\s{2,}((?:@[\w.-]+/)?[\w-]+(?:/[\w-]+)*))?$", ("line", "col", "severity", "message", "rule")),), one_for="place"),
    # "Error:" with the tool's tag before it or its stylesheet and place below it.
    "sass": Grammar("sass", "style", 95, (Pattern(r"^(?:\[(vite:[\w-]+)\]\s*)?(?:\[sass\]\s*)?Error:\s*(.+)$", ("plugin", "message")),),
                    (Pattern(_PATH + r"\.s[ac]ss)(?:\?\S*)?[\s:]+(\d+):(\d+)(?:\s+root stylesheet)?$", ("file", "line", "col")), Pattern(r"^file:\s*" + _PATH + r"\.s[ac]ss)(?:\?\S*)?$", ("file",))), needs_place=True),
    # The bundler's import errors, and the line after its banner for what else ends a build.
    "vite": Grammar("vite", "build", 90, (Pattern(rf"(?:\[plugin:([^\]]+)\]\s*)?(Failed to resolve import\s+{_QUOTED})(?:\s+from\s+{_INSIDE})?", ("plugin", "message", "file"), (("code", "unresolved"),)),
                                          Pattern(rf"(Could not resolve\b\s*{_QUOTED}(?:\s+from\b\s*{_INSIDE})?)", ("message", "file"), (("plugin", "rollup"), ("code", "unresolved"))),
                                          Pattern(r"(?i)^error during build:\n(?!.*(?:\[sass\]|could not resolve|failed to resolve))(?:\[([^\]]+)\]\s*)?(.+)$", ("plugin", "message"), pair=True))),
    # The plain form, file(line,column): error TSnnnn: text, and the pretty one, file:line:column - error TSnnnn: text.
    "typescript": Grammar("typescript", "typecheck", 85, tuple(Pattern(rf"^(\S.*){place}\s*{_CHECKED}", ("file", "line", "col", "code", "message")) for place in (r"\((\d+),(\d+)\):", r":(\d+):(\d+)\s+-"))),
    # An error's name and text, then the frames of its stack; those of packages and of the runtime say nothing of the place.
    "node": Grammar("node", "runtime", 80, (Pattern(r"^(?:\S+:\s+)?(?:Uncaught\s+)?Error:\s*(Cannot find module\s+['\"][^'\"]+['\"])", ("message",), (("code", "MODULE_NOT_FOUND"),)), Pattern(r"^(?:Uncaught\s+)?([A-Z]?\w*Error(?:\s\[\w+\])?:\s*.+)$", ("message",))),
                    (Pattern(r"^at\s(?!.*(?:node_modules|node:))(?:.*\()?" + _PATH + r"):(\d+):(\d+)\)?$", ("file", "line", "col")), Pattern(r"^at\s")), needs_place=True),
    # A line of the package manager that has one of its codes, or the exit code of what it ran.
    "pnpm-lifecycle": Grammar("pnpm", "lifecycle", 30, (Pattern(r"^((?:.*\W)?(ERR_PNPM(?:_[A-Z\d]+)+|ELIFECYCLE)\b.*)$", ("message", "code")), Pattern(r"(?i)^(.*\bfailed with exit code\s+(\d+).*)$", ("message", "rule"), (("code", "EXIT"),))), once=True, confidence="medium"),
}


#: What every line has that a grammar above knows: its heads say what is wrong, its places are numbers, files or frames.
_MAY_SAY = r"(?i)error|warning|resolve|ELIFECYCLE|ERR_PNPM|exit code|\d+:\d+|\.s[ac]ss|^\s*at\s|\.(?:[cm]?[jt]sx?|vue)\s*$"


def lines_of(step_logs: DataFrame) -> DataFrame:
    """The lines of each log of a step (0 standard output, 1 standard error), normalised, with the line after each."""
    logs = F.array(*(F.struct(F.lit(i).alias("log"), F.split(T.normalize_log(F.coalesce(F.col(c), F.lit(""))), "\n").alias("lines")) for i, c in enumerate(("stdout", "stderr"))))
    rows = step_logs.select(*CONTEXT, F.explode(logs).alias("_l")).select(*CONTEXT, "_l.log", "_l.lines")
    return rows.select(*CONTEXT, "log", "lines", F.posexplode("lines").alias("position", "line")).select(*CONTEXT, "log", "position", "line", F.get("lines", F.col("position") + 1).alias("next")).filter(F.trim("line") != "")


def candidates(lines: DataFrame, grammars: dict[str, Grammar] | None = None) -> DataFrame:
    """The records of all grammars among lines, with the columns of CANDIDATE."""
    grammars = GRAMMARS if grammars is None else grammars
    first = lambda ps: F.coalesce(*(p.fields() for p in ps)) if ps else F.lit(None).cast("struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">")
    known = F.array(*(F.struct(F.lit(n).alias("parser"), first(g.heads).alias("head"), first(g.places).alias("place")) for n, g in grammars.items()))
    if grammars is GRAMMARS:
        lines = lines.filter(F.col("line").rlike(_MAY_SAY) | F.coalesce(F.col("next").rlike(r"\S") & F.col("line").rlike("(?i)error during build"), F.lit(False)))
    rows = lines.select(*CONTEXT, "log", "position", F.trim("line").alias("line"), F.explode(F.filter(known, lambda x: x["head"].isNotNull() | x["place"].isNotNull())).alias("_g")).select(*CONTEXT, "log", "position", "line", "_g.*")
    # A head isn't a place of its own record; lines below it are, up to the next head.
    order = W.partitionBy(*_LOG, "parser").orderBy("position")
    rows = rows.withColumn("place", F.when(F.col("head").isNull(), F.col("place")))
    rows = rows.withColumn("record", F.count("head").over(order))
    within = W.partitionBy(*_LOG, "parser", "record").orderBy("position")
    ahead = within.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = rows.filter("record > 0").withColumns({
        "top": F.first("head").over(within), "top_line": F.first("line").over(within), "places": F.count("place").over(ahead),
        "where": F.first(F.when(F.col("place.file").isNotNull() | F.col("place.line").isNotNull(), F.struct("place", "line")), ignorenulls=True).over(ahead),
    })
    pick = lambda attribute: reduce(lambda c, n: c.when(F.col("parser") == n, F.lit(getattr(grammars[n], attribute))), list(grammars)[1:], F.when(F.col("parser") == next(iter(grammars)), F.lit(getattr(next(iter(grammars.values())), attribute))))
    by_place = pick("one_for") == "place"
    rows = rows.filter(F.when(by_place, F.col("place").isNotNull()).otherwise(F.col("head").isNotNull() & (~pick("needs_place") | (F.col("places") > 0))))
    # The first of a code; a bare exit code only where there is no other one.
    again = F.row_number().over(W.partitionBy(*_LOG, "parser", "head.code").orderBy("position"))
    coded = F.max(F.when(F.col("head.code") != "EXIT", 1)).over(W.partitionBy(*_LOG, "parser"))
    rows = rows.withColumns({"_again": again, "_coded": coded}).filter(~pick("once") | ((F.col("_again") == 1) & ((F.col("head.code") != "EXIT") | F.col("_coded").isNull())))
    own = {f: F.when(by_place, F.coalesce(F.col(f"place.{f}"), F.col(f"top.{f}"))).otherwise(F.coalesce(F.col(f"head.{f}"), F.col(f"where.place.{f}"))) for f in FIELDS}
    unresolved, plain_exit = F.col("head.code") == "unresolved", F.col("head.code") == "EXIT"
    out = {
        **own,
        "severity": F.coalesce(own["severity"], F.lit("error")),
        "message": own["message"],
        # Where no rule is named, an exit code stands there; import errors have no code of their own.
        "rule": F.when(~F.coalesce(plain_exit, F.lit(False)), own["rule"]),
        "code": F.when(F.coalesce(unresolved, F.lit(False)), F.lit(None)).when(plain_exit, F.concat(F.lit("EXIT_"), F.col("head.rule"))).otherwise(own["code"]),
        "line": own["line"].try_cast("int"), "col": own["col"].try_cast("int"),
        "category": F.when(unresolved, "module-resolution").otherwise(pick("category")),
        "confidence": pick("confidence"), "priority": pick("priority"), "tool": pick("tool"), "parser": F.col("parser"),
        "raw_excerpt": F.when(by_place, F.concat_ws("\n", "top_line", "line")).otherwise(F.concat_ws("\n", "line", F.col("where.line"))),
    }
    return rows.select(*((out[c] if c in out else F.col(c)).alias(c) for c in CANDIDATE))


def fallback(step_logs: DataFrame, found: DataFrame) -> DataFrame:
    """One generic candidate for each failed step that no grammar understood: its last line that speaks of a failure."""
    bad = step_logs.filter(F.col("status").isin("failed", "timed_out")).join(found.select("run_id", "step_id", "ordinal").distinct(), ["run_id", "step_id", "ordinal"], "left_anti")
    both = F.split(T.normalize_log(F.concat_ws("\n", "stderr", "stdout")), "\n")
    spoken = F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x.rlike(r"(?i)\b(error|fail(ed|ure)?|time(d\s?-?out|out)|exit(ed)?)\b"))
    timed = F.col("status") == "timed_out"
    silent = F.when(timed, F.format_string("Command timed out in step %s", "step_id")).otherwise(F.format_string("Command exited with code %s", F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown"))))
    given = {"parser": "generic", "tool": "generic", "priority": 0, "severity": "error", "confidence": "low", "log": 1, "position": 0}
    said = F.coalesce(F.try_element_at(spoken, F.lit(-1)), silent)
    own = {**{k: F.lit(v) for k, v in given.items()}, "category": F.when(timed, "timeout").otherwise("command"), "message": said, "raw_excerpt": said}
    kinds = dict(found.dtypes)
    return bad.select(*((F.col(c) if c in CONTEXT else own.get(c, F.lit(None)).cast(kinds[c])).alias(c) for c in CANDIDATE))


def parse(step_logs: DataFrame, grammars: dict[str, Grammar] | None = None) -> DataFrame:
    """Error events of step_logs: without machine paths, one for each fingerprint and run (the first by priority and place).

    The candidates are cut from their lineage, since the fallback asks for them again.
    """
    from lodeworks.sources.snapshots import cut

    found = cut(candidates(lines_of(step_logs), grammars))
    found = found.unionByName(fallback(step_logs, found))
    root, lab = F.coalesce("source_root", F.lit("")), F.coalesce("lab_root", F.lit(""))
    out = found.withColumns({"message": T.message(F.col("message"), root, lab), "file": relativize(F.col("file"), F.nullif("source_root", F.lit("")), F.nullif("lab_root", F.lit(""))), "raw_excerpt": T.excerpt(F.col("raw_excerpt"), root, lab)})
    out = out.withColumn("fingerprint", fingerprint(*(F.col(c) for c in ("parser", "tool", "category", "file", "line", "col", "message")), F.coalesce("rule", "code"), F.col("step_id")))
    w = W.partitionBy("run_id", "fingerprint").orderBy("ordinal", F.col("priority").desc(), "log", "position")
    out = out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    blocking = ~F.coalesce("allow_failure", F.lit(False)) & F.col("status").isin("failed", "timed_out")
    return out.withColumns({"id": F.concat(F.lit("error-"), F.substring("fingerprint", 1, 12)), "blocking": blocking})


def blocking_score(tool: Column, confidence: Column, located: Column) -> Column:
    """10 for a specific tool, 3, 2 or 1 for confidence, 2 for a place, code or rule."""
    return (F.when(tool.isin("pnpm", "generic"), 0).otherwise(10) + F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1) + F.when(located, 2).otherwise(0)).cast("long")


def first_blocking(events: DataFrame) -> DataFrame:
    """The event of each run that explains its failure best; the first of equals."""
    score = blocking_score(F.col("tool"), F.col("confidence"), F.coalesce("file", "code", "rule").isNotNull())
    w = W.partitionBy("run_id").orderBy(F.col("score").desc(), "ordinal", F.col("priority").desc(), "log", "position")
    return events.filter(F.col("blocking") & (F.col("severity") == "error")).withColumn("score", score).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("parser") != "generic").alias("recognized"), F.count_if(F.col("parser") == "generic").alias("unrecognized"))
