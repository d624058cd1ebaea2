"""Rules over the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value so far that isn't null."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def skip_after_failure(df: DataFrame, group: list[str], order: list[str], blocking: Column, name: str = "skipped") -> DataFrame:
    """Whether an earlier row of the group blocks."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(blocking).over(w), F.lit(False)))


def chain(df: DataFrame, group: list[str], order: list[str], state: str, legal: dict[str, list[str]], first: list[str]) -> DataFrame:
    """Each row with previous and legal: whether its state may follow the previous one (or be the first)."""
    w = W.partitionBy(*group).orderBy(*order)
    out = df.withColumn("previous", F.lag(state).over(w))
    ok = F.when(F.col("previous").isNull(), F.col(state).isin(*first))
    for a, bs in legal.items():
        ok = ok.when(F.col("previous") == a, F.col(state).isin(*bs) if bs else F.lit(False))
    return out.withColumn("legal", ok.otherwise(F.lit(False)))


#: States of a task and the states that may follow.
TASK_STATES = {
    "draft": ["validated", "aborted"], "validated": ["prepared", "aborted"], "prepared": ["handed_off", "aborted"], "handed_off": ["modified", "aborted"],
    "modified": ["policy_failed", "verification_failed", "verification_partial", "verification_passed", "aborted"],
    "policy_failed": ["verification_failed", "verification_partial", "verification_passed", "closed", "aborted"],
    "verification_failed": ["verification_failed", "verification_partial", "verification_passed", "closed", "aborted"],
    "verification_partial": ["verification_failed", "verification_partial", "verification_passed", "closed", "aborted"],
    "verification_passed": ["verification_failed", "verification_partial", "verification_passed", "closed", "aborted"],
    "closed": [], "aborted": [],
}
