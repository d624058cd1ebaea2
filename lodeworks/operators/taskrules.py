"""Rules of controlled tasks: acceptance criteria by type, named change policies, and evaluations of two variants."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.paths import glob_regex
from lodeworks.operators.quality import ratio

# Criterion types by what decides them, rules, and file names that rules ask for.
BY_HAND = ("manual_check", "browser_check", "custom")
BY_CHANGES = ("source_change", "file_not_changed", "path_allowed", "path_denied")
BY_TEXT = ("text_present", "text_absent", "export_present", "symbol_used")
BY_STEP = ("command_passes", "http_status")
CRITERIA = (*BY_CHANGES, "file_exists", *BY_TEXT, *BY_STEP, *BY_HAND)
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock")
MANIFESTS = ("package.json", "pnpm-workspace.yaml")
STOP_WORDS = "component components event workflow 使用 实现 定位 组件 示例 事件 公共 结构 说明 查找 一个 同时 确认 现有".split()

#: What a criterion expects; fields that its type doesn't ask for are null.
EXPECTED = "struct<path:string,paths:array<string>,glob:string,text:string,regex:string,minimum:int,step_id:string>"


def fits_any(path: Column, globs: Column) -> Column:
    return F.exists(globs, lambda g: F.rlike(path, glob_regex(g)))


def criteria_verdicts(criteria: DataFrame, changed: DataFrame, files: DataFrame, steps: DataFrame, before: bool = False) -> DataFrame:
    """(task_id, id, type, status, actual) of criteria (task_id, id, type, automated, expected).

    changed: (task_id, path, generated); files: (task_id, path, content); steps: (task_id, step_id, status). actual is the
    number of changed files that count for or against, 1 or 0 for what is there or not, null where nothing was looked at.
    before: whether work has yet to begin, when a step that hasn't run is no failure.
    """
    e = lambda f: F.col(f"expected.{f}")
    # A list wins over a path, a path over a glob; a change may be anywhere, and nothing is denied by default.
    globs = F.coalesce(e("paths"), F.when(F.col("type") == "source_change", F.array(F.coalesce(e("glob"), F.lit("**")))), F.when(e("path").isNotNull(), F.array(e("path"))), F.when(e("glob").isNotNull(), F.array(e("glob"))), F.when(F.col("type") == "path_allowed", F.array(F.lit("**"))), F.array(F.lit("")))
    # Sizes of exploded or shortened tables are guessed too small, so joins by task are told not to broadcast one.
    own = criteria.filter(F.col("type").isin(*BY_CHANGES)).select("task_id", "id", F.transform(globs, glob_regex).alias("_patterns"))
    own = own.join(changed.filter("not generated").select("task_id", F.col("path").alias("_path")).hint("merge"), "task_id")
    hit = F.exists("_patterns", lambda p: F.rlike(F.col("_path"), p))
    counts = own.groupBy("task_id", "id").agg(F.count_if(hit).alias("_in"), F.count_if(~hit).alias("_out"))
    there = files.select(F.col("task_id").alias("_of"), F.col("path").alias("_at"), "content")
    rows = criteria.join(counts.hint("merge"), ["task_id", "id"], "left").join(there.hint("merge"), (F.col("task_id") == F.col("_of")) & (e("path") == F.col("_at")), "left")
    done = steps.select(F.col("task_id").alias("_by"), F.col("step_id").alias("_step"), F.col("status").alias("_status"))
    rows = rows.join(done.hint("merge"), (F.col("task_id") == F.col("_by")) & (e("step_id") == F.col("_step")), "left")
    inside, outside = F.coalesce("_in", F.lit(0)), F.coalesce("_out", F.lit(0))
    holds = F.when(e("regex").isNotNull(), F.rlike(F.col("content"), F.concat(F.lit("(?m)"), e("regex")))).otherwise(F.contains("content", F.coalesce(e("text"), F.lit(""))))
    verdict = lambda ok: F.when(ok, "passed").otherwise("failed")
    kind = F.col("type")
    status = (F.when(kind.isin(*BY_HAND), "manual_required")
              .when(kind == "source_change", verdict(inside >= F.coalesce(e("minimum"), F.lit(1))))
              .when(kind.isin("file_not_changed", "path_denied"), verdict(inside == 0))
              .when(kind == "path_allowed", verdict(outside == 0))
              .when((kind == "file_exists") & e("path").isNotNull(), verdict(F.col("_at").isNotNull()))
              .when(kind.isin(*BY_TEXT) & e("path").isNotNull(), verdict(F.coalesce(holds == (kind != "text_absent"), F.lit(False))))
              .when(kind.isin(*BY_STEP), F.when(F.col("_status") == "passed", "passed").when(F.col("_status").isNull() & F.lit(before), "skipped").otherwise("failed"))
              .when(F.col("automated"), "failed").otherwise("manual_required"))
    actual = F.when(kind.isin("source_change", "file_not_changed", "path_denied"), inside).when(kind == "path_allowed", outside).when(kind == "file_exists", F.col("_at").isNotNull().cast("long")).when(kind.isin(*BY_TEXT), holds.cast("long")).when(kind.isin(*BY_STEP), (F.col("_status") == "passed").cast("long"))
    return rows.select("task_id", "id", "type", status.alias("status"), actual.cast("long").alias("actual"))


def policy_rules(policies: DataFrame, changed: DataFrame, inspected: DataFrame) -> DataFrame:
    """(task_id, rule, passed) of the fifteen rules.

    policies: task_id, allowed, denied, allowed_untracked, denied_extensions (arrays of globs or endings), max_changed,
    max_added, max_deleted, max_diff_lines, allow_untracked, lockfiles_read_only, manifests_read_only,
    no_conflict_markers, require_patch. changed: task_id, path, status, generated, is_binary, is_submodule,
    has_conflict. inspected: task_id, diff_lines, head_matches, has_patch.
    """
    name = F.substring_index("path", "/", -1)
    own = policies.select("task_id", "allowed", "denied", "allowed_untracked", "denied_extensions").join(changed.filter("not generated"), "task_id")
    new = F.col("status") == "untracked"
    tests = {
        "changed": F.lit(True), "added": F.col("status").isin("added", "untracked"), "deleted": F.col("status") == "deleted", "stray": ~fits_any(F.col("path"), F.col("allowed")), "barred": fits_any(F.col("path"), F.col("denied")),
        "new": new, "new_stray": new & ~fits_any(F.col("path"), F.col("allowed_untracked")), "ending": F.exists("denied_extensions", lambda x: F.endswith(F.col("path"), x)),
        "lockfiles": name.isin(*LOCKFILES), "manifests": name.isin(*MANIFESTS), "conflicts": F.col("has_conflict"), "binaries": F.col("is_binary"), "submodules": F.col("is_submodule"),
    }
    counts = own.groupBy("task_id").agg(*(F.count_if(c).alias(f"n_{k}") for k, c in tests.items()))
    facts = policies.join(counts, "task_id", "left").join(inspected.select("task_id", "diff_lines", "head_matches", "has_patch"), "task_id", "left").na.fill(0, [f"n_{k}" for k in tests])
    n = lambda k: F.col(f"n_{k}")
    unless = lambda flag, ok: ~F.col(flag) | ok
    rules = {
        "allowed-paths": n("stray") == 0, "denied-paths": n("barred") == 0, "max-changed-files": n("changed") <= F.col("max_changed"), "max-added-files": n("added") <= F.col("max_added"), "max-deleted-files": n("deleted") <= F.col("max_deleted"),
        "max-diff-lines": F.col("diff_lines") <= F.col("max_diff_lines"), "untracked-files": F.when(F.col("allow_untracked"), n("new_stray") == 0).otherwise(n("new") == 0), "denied-extensions": n("ending") == 0,
        "lockfiles-read-only": unless("lockfiles_read_only", n("lockfiles") == 0), "manifests-read-only": unless("manifests_read_only", n("manifests") == 0), "no-conflict-markers": unless("no_conflict_markers", n("conflicts") == 0),
        "no-binary": n("binaries") == 0, "no-submodule": n("submodules") == 0, "head-baseline": F.col("head_matches"), "patch": unless("require_patch", F.col("has_patch")),
    }
    cells = F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in rules.items()))
    return facts.select("task_id", F.explode(cells).alias("_r")).select("task_id", "_r.rule", "_r.passed")


def policy_results(rules: DataFrame) -> DataFrame:
    """(task_id, status, failed): failed rules in the order of their names; every rule blocks."""
    return rules.groupBy("task_id").agg(F.when(F.bool_and("passed"), "passed").otherwise("failed").alias("status"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule")))).alias("failed"))


def compared(tasks: DataFrame, raw: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Two contexts of each task (id, must_recall, must_not_include, allowed_raw_fallback) side by side.

    raw and knowledge: (task_id, markdown, fallbacks). For both: tokens, recall (1 where nothing is expected), prohibited;
    and the difference in tokens, which is shorter, and whether the raw fallbacks are within what the task allows.
    """
    def measured(df: DataFrame, side: str) -> DataFrame:
        rows = tasks.join(df.select(F.col("task_id").alias("id"), "markdown", "fallbacks"), "id")
        low = F.lower("markdown")
        named = lambda terms: F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
        return rows.select("id", F.ceil(F.length("markdown") / 4).cast("long").alias(f"{side}_tokens"), ratio(named("must_recall"), F.size("must_recall"), 1.0).alias(f"{side}_recall"), named("must_not_include").cast("long").alias(f"{side}_prohibited"), F.col("fallbacks").cast("long").alias(f"{side}_fallbacks"))

    out = tasks.select("id", "allowed_raw_fallback").join(measured(raw, "raw"), "id").join(measured(knowledge, "knowledge"), "id")
    delta = F.col("knowledge_tokens") - F.col("raw_tokens")
    return out.withColumns({"delta_tokens": delta, "length": F.when(delta < 0, "shorter").when(delta > 0, "longer").otherwise("tie"), "within_allowance": F.col("knowledge_fallbacks") <= F.col("allowed_raw_fallback")})


def terms_of(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Distinct words of a question in lower case, without single characters and stop words; add the names that all questions have."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words)))


def context(items: DataFrame, group: list[str], phases: list[str], budget: int, keep: dict[str, int] | None = None, constant: int = 0) -> DataFrame:
    """The items (phase, place, tokens) of each group that stay when a context is trimmed to a budget, phase after phase.

    The last phase of phases is trimmed first, each from its end on, down to the items that keep names for it. What the
    phases before need is known from their sums, so one window over the phases' sizes and one within each phase tell
    which items stay; where the budget can't be met the kept items stay alone.
    """
    from pyspark.sql import Window as W

    least = keep or {}
    number = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    floor = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in phases for x in (p, least.get(p, 0)))), F.col("phase")), F.lit(0))
    inner = W.partitionBy(*group, "phase").orderBy("place")
    rows = items.withColumns({"_phase": number, "_row": F.row_number().over(inner), "_upto": F.sum("tokens").over(inner)}).withColumn("_must", F.col("_row") <= floor)
    sizes = rows.groupBy(*group, "_phase").agg(F.sum("tokens").alias("_all"), F.coalesce(F.sum(F.when(F.col("_must"), F.col("tokens"))), F.lit(0)).alias("_least"))
    # Room of a phase: the budget without earlier phases as they are, and without what later ones must keep.
    order = W.partitionBy(*group).orderBy("_phase")
    earlier = F.coalesce(F.sum("_all").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    later = F.coalesce(F.sum("_least").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    room = sizes.select(*group, "_phase", (F.lit(budget - constant) - earlier - later).alias("_room"))
    return rows.join(room, [*group, "_phase"]).filter(F.col("_must") | (F.col("_upto") <= F.col("_room"))).drop("_phase", "_row", "_upto", "_must", "_room")
