"""Counts over whole texts, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import count_of, words_of

SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5


def _pairwise(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def with_counts(df: DataFrame, text_col: str = "text", windows: bool = True) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_upper, n_marks, n_other, n_distinct, n_lines and n_dup_lines of text_col (null: no text),
    and with n_repeat_words if windows is set.

    The arrays, and what a text has besides letters, digits and white space, are columns of projections of their own, each
    used more than once above, so that each is made once a row.
    Windows are compared by 64-bit hashes within one text.
    """
    had = df.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns({"_words": words_of(text), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "_marks": F.regexp_replace(text, r"[\p{L}\p{N}\s]+", "")})
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count_of(F.col("_marks"), SYMBOLS).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_marks": count_of(F.col("_marks"), "!?").cast("long"),
        "n_other": F.length("_marks").cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }
    if not windows:
        return out.withColumns(counts).select(*had, *counts)
    out = out.withColumns({**counts, "_h": F.transform("_words", lambda w: F.xxhash64(w))}).drop("_words", "_lines", "_marks")
    # The hash of words i to i+4, for each i with so many: of pairs, of fours, and the fifth.
    out = out.withColumn("_h2", _pairwise(F.col("_h"), F.slice("_h", 2, F.greatest(F.size("_h"), F.lit(1)))))
    out = out.withColumn("_h4", _pairwise(F.col("_h2"), F.slice("_h2", 3, F.greatest(F.size("_h"), F.lit(1)))))
    out = out.withColumn("_grams", F.slice(_pairwise(F.col("_h4"), F.slice("_h", WINDOW, F.greatest(F.size("_h"), F.lit(1)))), 1, F.greatest(F.size("_h") - WINDOW + 1, F.lit(0)))).drop("_h", "_h2", "_h4")
    # Texts without a repeated window, nearly all, stop here.
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("_grams")
    touching = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    out = out.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.filter(touching, lambda x: x.isNotNull()))))).drop("_sorted")
    # Each repeated window adds the words up to the next one, WINDOW of them at most.
    steps = F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")).select(*had, *counts, "n_repeat_words")
