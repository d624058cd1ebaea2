"""Contexts under a budget, for many tasks at once: blocks in sections, each with what only it needs.

A context keeps its blocks from the front: what is trimmed goes from the end, phase after phase, and takes along the
evidence that nothing left refers to. So a piece of evidence costs its size at the first block, in the order of keeping,
that refers to it, and the blocks that fit are the longest run from the front of that order whose sizes add up to the
budget: one window a task, and no loop of dropping and measuring again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which candidates come first, and how many of a type a context takes. Fixed values.
PRIORITY = {"component": 100, "symbol": 90, "public_export": 85, "example": 75, "section": 65}
MOST = {"symbol": 7, "section": 4, "example": 3}
#: Characters that count as a token.
TOKEN = 4


def chosen(selected: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """Of a retrieval's selected candidates those that contexts take, with place: by type, score and id."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("type")), F.lit(40))
    order = [rank.desc(), F.col("score").desc(), F.col("id")]
    most = MOST if most is None else most
    rows = selected.filter("selected").withColumn("_n", F.row_number().over(W.partitionBy("task_id", "type").orderBy(*order)))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in most.items() for x in kv)), F.col("type"))
    rows = rows.filter(cap.isNull() | (F.col("_n") <= cap)).drop("_n")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("task_id").orderBy(*order)).cast("long"))


def claims_of(cards: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, left out) of the claims (card, claim, text, status, evidence array, place) of tasks' cards (task_id, card, place).

    Inferred claims are left out with their reason; usable ones have task_id, id, place in the order of cards and claims.
    """
    rows = cards.withColumnRenamed("place", "_card").join(claims.withColumnRenamed("place", "_claim"), "card")
    usable = rows.filter("status <> 'inferred'").withColumn("place", F.row_number().over(W.partitionBy("task_id").orderBy("_card", "card", "_claim", "claim")).cast("long"))
    return usable.select("task_id", F.concat_ws("/", "card", "claim").alias("id"), "text", "status", "evidence", "place"), rows.filter("status = 'inferred'").select("task_id", "card", "claim", F.lit("inferred filtered").alias("reason"))


def numbered_evidence(usable: DataFrame) -> DataFrame:
    """(task_id, evidence, number): evidence of a task's usable claims, numbered from 1 as first referred to."""
    each = usable.select("task_id", "place", F.posexplode("evidence").alias("_at", "evidence"))
    first = each.groupBy("task_id", "evidence").agg(F.min(F.struct("place", "_at")).alias("_first"))
    return first.select("task_id", "evidence", F.row_number().over(W.partitionBy("task_id").orderBy("_first", "evidence")).cast("long").alias("number"))


def trimmed(blocks: DataFrame, needs: DataFrame | None, phases: list[str], budget: int, constant: Column | int = 0, keep: int = 1) -> DataFrame:
    """blocks (task_id, phase, place, id, text) with kept, fits and chars, the characters of the context they are in.

    needs: (task_id, id, piece, text) pieces that blocks refer to, in a context as long as one of these blocks is; None if
    blocks have them in a column needs, an array of (piece, text). The first keep blocks of each phase stay, then as many
    as fit: of phases[0] first, of the last phase last. Each text takes its characters and a line end. fits: whether what
    must stay is within the budget (tokens of TOKEN characters). All is windows within tasks, so that blocks that are dealt
    by task_id and have their needs with them are not dealt again.
    """
    size = lambda c: F.length(c) + 1
    number = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    rows = blocks if needs is None else blocks.join(needs.groupBy("task_id", "id").agg(F.collect_set(F.struct("piece", "text")).alias("needs")), ["task_id", "id"], "left")
    rows = rows.withColumns({"_phase": number, "_row": F.row_number().over(W.partitionBy("task_id", "phase").orderBy("place", "id"))})
    rows = rows.withColumn("_must", F.col("_row") <= keep)
    front = W.partitionBy("task_id").orderBy((~F.col("_must")).cast("int"), "_phase", "_row")
    rows = rows.withColumn("_turn", F.row_number().over(front).cast("long"))
    # Each piece falls to the first block in that order: a row for each piece of a block, of which the first stands for the block.
    pieces = F.array_distinct(F.transform("needs", lambda x: F.struct(x["piece"].alias("piece"), size(x["text"]).alias("size"))))
    rows = rows.select("*", F.posexplode_outer(pieces).alias("_at", "_p")).withColumn("_own", F.coalesce("_at", F.lit(0)) == 0)
    new = F.row_number().over(W.partitionBy("task_id", "_p.piece").orderBy("_turn", "_p.size")) == 1
    rows = rows.withColumn("_more", F.when(new, F.coalesce("_p.size", F.lit(0))).otherwise(0) + F.when(F.col("_own"), size("text")).otherwise(0))
    upto = F.sum("_more").over(W.partitionBy("task_id").orderBy("_turn").rangeBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto).filter("_own")
    total = F.col("_upto") + (F.lit(constant) if isinstance(constant, int) else constant)
    rows = rows.withColumns({"_total": total, "_ok": total <= budget * TOKEN})
    whole = W.partitionBy("task_id")
    rows = rows.withColumn("kept", F.col("_must") | F.col("_ok"))
    fits = F.bool_and(~F.col("_must") | F.col("_ok")).over(whole)
    chars = F.max(F.when(F.col("kept"), F.col("_total"))).over(whole)
    return rows.withColumns({"fits": fits, "chars": chars.cast("long")}).select(*(c for c in blocks.columns), "kept", "fits", "chars")


def pieces_left(done: DataFrame, needs: DataFrame) -> DataFrame:
    """(task_id, piece, text) that the kept blocks of trimmed() refer to."""
    kept = done.filter("kept").select("task_id", "id")
    return needs.join(kept, ["task_id", "id"], "left_semi").groupBy("task_id", "piece").agg(F.min("text").alias("text"))


def rendered(done: DataFrame, pieces: DataFrame, head: DataFrame, titles: dict[str, str], evidence_title: str) -> DataFrame:
    """(task_id, fits, tokens, markdown): heads (task_id, text), the kept blocks by phase under titles, and the pieces left.

    A context has no more characters than its budget, so that its rows may meet in one string.
    """
    line = lambda df, section, place, text: df.select("task_id", F.lit(section).alias("section"), place.cast("string").alias("place"), text.alias("text"))
    rows = line(head, 0, F.lit(""), F.col("text"))
    for k, phase in enumerate(titles):
        rows = rows.unionByName(line(done.filter(F.col("kept") & (F.col("phase") == phase)), k + 1, F.concat_ws("|", F.lpad(F.col("place").cast("string"), 12, "0"), "id"), F.col("text")))
    rows = rows.unionByName(line(pieces, len(titles) + 1, F.col("piece"), F.col("text")))
    names = ["", *titles.values(), evidence_title]
    named = F.element_at(F.array(*map(F.lit, names)), F.col("section") + 1)
    parts = rows.groupBy("task_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("_t"))
    parts = parts.withColumn("_t", F.concat(F.when(named != "", F.concat(F.lit("## "), named, F.lit("\n\n"))).otherwise(""), "_t"))
    out = parts.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "_t"))), lambda x: x["_t"]), "\n\n").alias("markdown"))
    fits = done.groupBy("task_id").agg(F.bool_and("fits").alias("fits"))
    return out.join(fits, "task_id", "left").select("task_id", F.coalesce("fits", F.lit(True)).alias("fits"), F.ceil(F.length("markdown") / TOKEN).cast("long").alias("tokens"), "markdown")
