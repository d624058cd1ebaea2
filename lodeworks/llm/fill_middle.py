"""Fill-in-middle transformation: cut each text in three, and move the middle to the end behind sentinels.

A text is decoded to an array of code points. Code points of one unit share a class, and neighbours of different units
differ in theirs, so the places where neighbouring classes differ are the places where a text may be cut. Two of them
are picked by hashes of the id; the pieces are slices of the array, encoded again. A text that holds a sentinel stays
plain, as do an empty one and a share of all others; of the rest a share puts the suffix first. restored() gives the
exact text back from the result alone.

Each text is handled alone: no shuffle. Results leave a task in blocks of bounded size.

Cases: null counts as the empty text, which stays plain; a null id is hashed as an empty string; rows with equal ids are
cut by the same hashes; very long texts are cut whole, with 13 bytes a code point at the peak; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts, in percent, that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points that a task holds at most before it hands over what it has.
_BLOCK = 4_000_000
_OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def classes(codes: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; neighbours of one unit have the same, those of two units differ."""
    if unit == "char":
        return np.arange(len(codes), dtype=np.uint32) & 1
    if unit == "word":
        return (codes == 32) | ((codes >= 9) & (codes <= 13))
    if unit == "line":
        return np.concatenate(([0], np.cumsum(codes == 10, dtype=np.int64)[:-1]))[: len(codes)]
    raise ValueError(f"no such unit: {unit}")


def boundaries(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units start, and the end of the text."""
    own = classes(codes, unit)
    inner = np.flatnonzero(own[1:] != own[:-1]) + 1
    return np.concatenate(([0], inner, [len(codes)])) if len(codes) else np.zeros(1, np.int64)


def cut(text: str, key: str, unit: str = "char", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(code points, form, those of the prefix, those of the middle, output) of one text; key: hex digits that decide, 32 at least."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return len(codes), "plain", None, None, text
    at = boundaries(codes, unit)
    a, b = sorted((int(at[h1 % len(at)]), int(at[h2 % len(at)])))
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(codes))))
    if h4 % 100 < suffix_first:
        return len(codes), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(codes), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _cut_all(unit: str, plain: int, suffix_first: int):
    def block(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=names)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for i, key, text in zip(*(batch.column(name) for name in ("doc_id", "key", "text")), strict=True):
                rows.append((i.as_py(), *cut(text.as_py(), key.as_py(), unit, plain, suffix_first)))
                held += rows[-1][1]
                if held > _BLOCK or len(rows) >= 10_000:
                    yield block(rows)
                    rows, held = [], 0
        if rows:
            yield block(rows)

    return run


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars, output.

    unit: where texts may be cut: char, word (runs of white space and of other characters) or line. plain and
    suffix_first are percentages.
    """
    own = F.col(id_col).cast("long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    rows = docs.select(own.alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut_all(unit, plain, suffix_first), _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that transform() made output of. No sentinel lies in a text, so the first of each is the one that was put there."""
    body = F.substring(output, 4, 2_147_483_647)

    def parts(text: Column, by: str) -> tuple[Column, Column]:
        return F.split_part(text, F.lit(by), F.lit(1)), F.split_part(text, F.lit(by), F.lit(2))

    prefix, rest = parts(body, SUFFIX)
    suffix, middle = parts(rest, MIDDLE)
    suffix2, rest2 = parts(body, PREFIX)
    prefix2, middle2 = parts(rest2, MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at code points, with digests of the output and of the text that is restored from it."""
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), numbers AS (
    SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(key, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(key, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(key, 25, 8) AS BIGINT) AS h4 FROM hashed
), places AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), pieces AS (
    SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM places
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
