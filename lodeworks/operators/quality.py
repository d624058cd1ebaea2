"""Coverage, gaps, quality, reconciliation and policy rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, empty: float | None) -> Column:
    """numerator / denominator, and what an empty denominator means."""
    return F.when(denominator == 0, F.lit(empty).cast("double")).otherwise(numerator.cast("double") / F.nullif(denominator, F.lit(0)))


def statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, exact median, min and max; null without values.

    The median is read off running counts of the distinct values, so that no group has to fit in memory.
    """
    whole = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_k"))
    counts = counts.withColumns({"_upto": F.sum("_k").over(W.partitionBy(*group).orderBy(value)), "_n": F.sum("_k").over(W.partitionBy(*group))})
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_k") <= place)
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = counts.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(((F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2).alias("median"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    return whole.join(middle, same or F.lit(True), "left").select(*group, "n", "mean", "median", "min", "max")


def zero_filled(dim: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """A count for every key of dim, 0 where facts has none."""
    n = facts.groupBy(key).agg(F.count("*").alias("n"))
    return dim.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def gap_score(public: Column, reuse: Column, evidence: Column, cost: Column, task_hits: Column | None = None, raw_fallback: Column | None = None) -> Column:
    """3 task hits + 2 raw fallback + 4 public (5 if so) + 2 reuse + 2 evidence - 2 cost, counts capped at 5."""
    cap = lambda c: F.least(F.lit(5), c)
    none = F.lit(0)
    return (3 * (task_hits if task_hits is not None else none) + 2 * (raw_fallback if raw_fallback is not None else none) + 4 * F.when(public, 5).otherwise(0) + 2 * cap(reuse) + 2 * cap(evidence) - 2 * cap(cost)).cast("long")


def priority_score(business: Column, centrality: Column, dependency: Column, evidence: Column, demand: Column, family: Column, feasibility: Column, risk: Column) -> Column:
    return (4 * business + 3 * centrality + 2 * dependency + 2 * evidence + 3 * demand + 2 * family + feasibility - 2 * risk).cast("long")


def quality_level(all_evidenced: Column, scope_complete: Column, inferred: Column, unverified_recipe: Column, has_limitations: Column) -> Column:
    return F.when(~all_evidenced | ~scope_complete, "blocked").when(inferred | unverified_recipe | ~has_limitations, "medium").otherwise("high")


def break_even(investment: Column, mean_saved: Column) -> Column:
    """Uses after which an investment pays, null if nothing is saved."""
    return F.when(mean_saved > 0, F.ceil(investment / F.nullif(mean_saved, F.lit(0)))).cast("long")


def families(df: DataFrame, item: str, signals: Column, least: int = 2, representatives: int = 3) -> DataFrame:
    """signal, n, representatives of the signals that several items share."""
    rows = df.select(item, F.explode(F.array_distinct(signals)).alias("signal")).distinct()
    big = rows.groupBy("signal").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("signal").orderBy(item))).filter(F.col("_r") <= representatives)
    names = first.groupBy("signal").agg(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ",").alias("representatives"))
    return big.join(names, "signal")


def reconcile(values: DataFrame, group: list[str], kind: str, ordinal: str, type_col: str, default: str, commit: str, target: Column) -> DataFrame:
    """One row an item: n sources, distinct types and defaults (first of each source kind), conflict and status."""
    canon = lambda c: F.nullif(F.lower(F.regexp_replace(F.col(c), r"\s+", "")), F.lit(""))
    first = lambda c: F.min_by(canon(c), F.when(canon(c).isNotNull(), F.col(ordinal)))
    by_kind = values.groupBy(*group, kind).agg(first(type_col).alias("_t"), first(default).alias("_d"), F.bool_or(F.col(commit) != target).alias("_c"))
    out = by_kind.groupBy(*group).agg(F.count("*").alias("n_sources"), F.countDistinct("_t").alias("n_types"), F.countDistinct("_d").alias("n_defaults"), F.coalesce(F.bool_or("_c"), F.lit(False)).alias("commit_mismatch"), F.min(kind).alias("_k"), F.bool_or(F.col(kind) == "runtime-record").alias("_run"))
    conflict = (F.col("n_types") > 1) | (F.col("n_defaults") > 1) | F.col("commit_mismatch")
    status = (F.when(conflict, "conflict").when((F.col("n_sources") >= 2) | F.col("_run"), "verified").when(F.col("_k") == "official-doc", "documented")
              .when(F.col("_k").isin("source-code", "type-definition"), "inferred").otherwise("unverified"))
    out = out.withColumn("status", status).drop("_k", "_run")
    return out.withColumn("confidence", F.when(F.col("status") == "verified", "high").when(F.col("status") == "conflict", "low").otherwise("medium"))


def item_key(name: Column, event: bool = False) -> Column:
    key = F.regexp_replace(F.lower(name), r"[-_\s]", "")
    return F.regexp_replace(key, "^nc", "") if event else key


def page_quality(has_body: Column, status: Column, text_chars: Column, extracted: Column, missing: Column, app_shell: Column) -> Column:
    return (F.when(~has_body | status.isNull() | (status >= 400), "failed").when((text_chars == 0) | (app_shell & (text_chars < 200)) | (extracted == 0), "empty").when(missing == 0, "complete").otherwise("partial"))


def rule_rows(facts: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule, passed) from a row of facts for each key."""
    cells = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()))
    return facts.select(*key, F.explode(cells).alias("_r")).select(*key, "_r.rule", "_r.passed")


def run_status(df: DataFrame, group: list[str], failed: Column, allowed: Column) -> DataFrame:
    """failed if a failure isn't allowed, partial if one is, else passed."""
    out = df.groupBy(*group).agg(F.bool_or(failed & ~allowed).alias("_f"), F.bool_or(failed & allowed).alias("_p"))
    return out.select(*group, F.when(F.col("_f"), "failed").when(F.col("_p"), "partial").otherwise("passed").alias("status"))


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(rule, n, first key) of the rows that break each rule; a null check breaks it."""
    cells = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items())))
    return df.select(key, F.explode(cells).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def acceptance(facts: DataFrame, key: list[str], criteria: dict[str, Column | None]) -> DataFrame:
    """(key, criterion, status): passed or failed; blocked if the facts say nothing; manual_required for criteria without a test."""
    verdict = lambda c: F.lit("manual_required") if c is None else F.when(c.isNull(), "blocked").when(c, "passed").otherwise("failed")
    cells = F.array(*(F.struct(F.lit(n).alias("criterion"), verdict(c).alias("status")) for n, c in criteria.items()))
    return facts.select(*key, F.explode(cells).alias("_c")).select(*key, "_c.criterion", "_c.status")


def policy_verdict(facts: DataFrame, key: list[str], rules: dict[str, Column], blocking: set[str]) -> DataFrame:
    """Each key's violations, those of blocking rules, and verdict."""
    rows = rule_rows(facts, key, rules)
    bad, hard = ~F.col("passed"), F.col("rule").isin(*blocking)
    out = rows.groupBy(*key).agg(F.count_if(bad).alias("violations"), F.count_if(bad & hard).alias("blocked"))
    return out.withColumn("verdict", F.when(F.col("blocked") > 0, "blocked").when(F.col("violations") > 0, "failed").otherwise("passed"))
