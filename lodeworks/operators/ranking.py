"""Selections by rank: caps, budgets, first wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_n(df, key, order, 1)


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group and task before the shuffle (WindowGroupLimit)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's 1-based place in the order of the whole table, which must be total.

    Rows are dealt into ranges of the order and sorted within them; a range's rows are shifted by the counts of earlier
    ranges, so that no task gets all rows.
    """
    from lodeworks.sources.snapshots import cut

    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # Such an id is the number of the range and the place in it.
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at", "_part", "_before")


def capped_topk(df: DataFrame, score: str, type_col: str, key: list[str], caps: dict[str, int], default_cap: int, limit: int, tie: list[str]) -> DataFrame:
    """Greedy selection by score: drop non-positive scores, first of each key, a cap for each type, then a limit.

    Equal to the sequential greedy choice as long as key contains the type: a row that a full cap refuses can't unblock a
    later duplicate. The overall rank is taken over at most sum(caps) rows a type.
    """
    order = [F.col(score).desc(), *(F.col(t) for t in tie)]
    kept = first_wins(df.filter(F.col(score) > 0), key, order)
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(type_col)), F.lit(default_cap)) if caps else F.lit(default_cap)
    most = max([default_cap, *caps.values()])
    kept = top_n(kept, [type_col], order, most, "type_rank").filter(F.col("type_rank") <= cap)
    return kept.orderBy(*order).limit(limit)


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], size: Column, budget: int, separator: int = 1, least: int = 1) -> DataFrame:
    """Each group's longest prefix whose sizes, with separators between, fit the budget; at least the first rows stay.

    With a separator no more rows than the budget has room for can stay, which prunes groups before they are shuffled.
    """
    w = W.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("rank", F.row_number().over(w).cast("long"))
    if separator > 0:
        rows = rows.filter(F.col("rank") <= max(least, budget // separator + 1))
    rows = rows.withColumns({"_sum": F.sum(size.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.withColumn("used", (F.col("_sum") + separator * (F.col("rank") - 1)).cast("long")).drop("_sum")
    return rows.filter((F.col("used") <= budget) | (F.col("rank") <= least))


def trim_phases(items: list[list[int]], constant: int, budget: int, keep: list[int], separator: int = 1) -> list[int] | None:
    """How many items of each phase stay when phases are trimmed in order, each from its end down to its keep; None if it can't fit.

    For the few items of one context; large sets use budget_prefix.
    """
    left = [len(x) for x in items]
    total = lambda: constant + sum(sum(x[:n]) + separator * max(0, n - 1) for x, n in zip(items, left, strict=True))
    for phase, least in enumerate(keep):
        while total() > budget and left[phase] > least:
            left[phase] -= 1
    return left if total() <= budget else None


def numbered(df: DataFrame, group: list[str], item: str, ordinal: str, name: str = "number") -> DataFrame:
    """Items numbered 1.. in the order in which they are first seen in their group."""
    seen = df.groupBy(*group, item).agg(F.min(ordinal).alias("first_seen"))
    return seen.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy("first_seen", item)).cast("long"))


def sequential_pick(df: DataFrame, group: str, order: list[str], type_col: str, caps: dict[str, int], default_cap: int, file: str, start: str, end: str, skip: str) -> DataFrame:
    """Snippets in order: a cap for each type, then the skip flag, then ranges that an accepted snippet covers are refused.

    A type's cap counts the rows it has looked at, taken or not, so the first rows of each type are the ones that may be
    taken; of these, those that aren't skipped are taken unless an earlier one has the same range.
    """
    by = [F.col(c) for c in order]
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col(type_col)), F.lit(default_cap)) if caps else F.lit(default_cap)
    looked = df.withColumn("_n", F.row_number().over(W.partitionBy(group, type_col).orderBy(*by))).filter(F.col("_n") <= cap).drop("_n")
    return first_wins(looked.filter(~F.col(skip)), [group, file, start, end], by)
