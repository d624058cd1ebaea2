"""Differences of keyed snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str], reclassified: str | None = None) -> DataFrame:
    """key and change (added, removed, modified, reclassified, unchanged) by one full outer join.

    modified: a compared column differs, nulls being equal; reclassified: only that column does.
    """
    cols = [*compared, *([reclassified] if reclassified else [])]
    o = old.select(F.col(key).alias("_k"), F.struct(*cols).alias("_o"))
    n = new.select(F.col(key).alias("_n"), F.struct(*cols).alias("_v"))
    both = o.join(n, F.col("_k") == F.col("_n"), "full_outer")
    differs = lambda c: ~F.col(f"_o.{c}").eqNullSafe(F.col(f"_v.{c}"))
    changed = F.lit(False)
    for c in compared:
        changed = changed | differs(c)
    change = F.when(F.col("_k").isNull(), "added").when(F.col("_n").isNull(), "removed").when(changed, "modified")
    if reclassified:
        change = change.when(differs(reclassified), "reclassified")
    return both.select(F.coalesce("_k", "_n").alias(key), change.otherwise("unchanged").alias("change"))


def unique_moves(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Pairs of a removed and an added key whose digest is unique on both sides."""
    once = lambda df, name: df.groupBy(digest).agg(F.count("*").alias("_n"), F.min(key).alias(name)).filter("_n = 1").drop("_n")
    gone = old.join(new, key, "left_anti")
    come = new.join(old, key, "left_anti")
    pairs = once(old, "old_key").join(once(new, "new_key"), digest)
    return pairs.join(gone.select(F.col(key).alias("old_key")), "old_key", "left_semi").join(come.select(F.col(key).alias("new_key")), "new_key", "left_semi").select("old_key", "new_key", digest)


def set_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and status: resolved, new or unchanged."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    label = lambda df, s: df.select(key, F.lit(s).alias("status"))
    return label(a.join(b, key, "left_anti"), "resolved").unionByName(label(b.join(a, key, "left_anti"), "new")).unionByName(label(a.join(b, key, "left_semi"), "unchanged"))


def evidence_impact(refs: DataFrame, old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """What became of each reference (path, digest): unchanged, relocated, removed, newly_available or changed."""
    at = lambda df, name: df.select(F.col(path).alias("_p"), F.col(digest).alias(name))
    out = refs.join(at(old, "old_digest"), refs[path] == F.col("_p"), "left").drop("_p").join(at(new, "new_digest"), refs[path] == F.col("_p"), "left").drop("_p")
    there = new.select(F.col(digest).alias("_d")).distinct().withColumn("_there", F.lit(True))
    out = out.join(there, out[digest] == F.col("_d"), "left").drop("_d")
    same = (F.col("new_digest") == F.col(digest)) & (F.col("old_digest") == F.col(digest))
    moved = ~F.col("new_digest").eqNullSafe(F.col(digest)) & F.coalesce("_there", F.lit(False))
    return out.withColumn("impact", F.when(same, "unchanged").when(moved, "relocated").when(F.col("new_digest").isNull(), "removed").when(F.col("old_digest").isNull(), "newly_available").otherwise("changed")).drop("_there")


def claim_state(in_target: Column, affected: Column, manual: Column) -> Column:
    return F.when(in_target, "current").when(affected, "stale").when(manual, "partially_stale").otherwise("carried_forward")
