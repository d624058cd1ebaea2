"""Line diffs of two texts as columns: hunks with as few changed lines as possible, counts, and patches in unified form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 3
UNENDED = "\n\\ No newline at end of file"
_EDIT = "struct<kept:int,old:int,removed:int,new:int,added:int>"
_HUNKS = f"array<struct<old:int,old_lines:int,new:int,new_lines:int,edits:array<{_EDIT}>>>"


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest common subsequence of b with each prefix of a, one bit of a long integer for each line of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = rest = (1 << len(a)) - 1
    for y in b:
        hit = rest & places.get(y, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    bits = np.unpackbits(np.frombuffer(rest.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(1 - bits[: len(a)].astype(np.int64))))


def _matches(a: list[int], b: list[int], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Append the pairs of a longest common subsequence, in order; memory grows with the lines, not with their product."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append((i + head, j + head))
        head += 1
    a, b, i, j = a[head:], b[head:], i + head, j + head
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i + len(a) - k, j + len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(b) == 1 and b[0] in a:
        out.append((i + a.index(b[0]), j))
    elif len(b) > 1 and a:
        half = len(b) // 2
        cut = int(np.argmax(_prefix_lengths(a, b[:half]) + _prefix_lengths(a[::-1], b[: half - 1 : -1])[::-1]))
        _matches(a[:cut], b[:half], i, j, out)
        _matches(a[cut:], b[half:], i + cut, j + half, out)
    out.extend(ends)


def edits(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old place, lines removed, new place, lines added) of each change, places counted from 0."""
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(x, len(ids)) for x in lines] for lines in (old, new))
    both = set(a) & set(b)
    # What the other text doesn't have can't be in common.
    at, bt = [k for k, x in enumerate(a) if x in both], [k for k, x in enumerate(b) if x in both]
    pairs: list[tuple[int, int]] = []
    _matches([a[k] for k in at], [b[k] for k in bt], 0, 0, pairs)
    out, i, j = [], 0, 0
    for x, y in [(at[x], bt[y]) for x, y in pairs] + [(len(a), len(b))]:
        if (x, y) != (i, j):
            out.append((i, x - i, j, y - j))
        i, j = x + 1, y + 1
    return out


def _grouped(old: list[str], new: list[str], context: int) -> list[dict]:
    """Changes with their context; those that at most twice the context sets apart are one hunk."""
    out: list[dict] = []
    for i, removed, j, added in edits(old, new):
        last = out[-1]["edits"][-1] if out else None
        gap = i - last["old"] - last["removed"] if last else None
        if gap is None or gap > 2 * context:
            kept = min(i, context)
            out.append({"old": i - kept, "new": j - kept, "edits": []})
        else:
            kept = gap
        out[-1]["edits"].append({"kept": kept, "old": i, "removed": removed, "new": j, "added": added})
    for h in out:
        e = h["edits"][-1]
        tail = min(context, len(old) - e["old"] - e["removed"])
        h["old_lines"] = e["old"] + e["removed"] + tail - h["old"]
        h["new_lines"] = e["new"] + e["added"] + tail - h["new"]
    return out


def lines(text: Column) -> Column:
    """A text's lines without their ends; a last line that has none carries the mark that patches have for it. Null: no lines."""
    parts = F.split(text, "\n")
    body = F.slice(parts, F.lit(1), F.size(parts) - 1)
    last = F.element_at(parts, -1)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(last == "", body).otherwise(F.concat(body, F.array(F.concat(last, F.lit(UNENDED)))))


def hunks(old: Column, new: Column, context: int = CONTEXT) -> Column:
    """The hunks between two arrays of lines: places from 0, lines of each side, and the changes within.

    The changes are a longest common subsequence's complement, so no other diff has fewer lines. Lines are equal when
    identical. Time grows with the product of the lines that both texts have between their first and last change, divided
    by the bits of a machine word; memory with their number.
    """
    @F.pandas_udf(_HUNKS)
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_grouped(list(x), list(y), context) for x, y in zip(a, b)], dtype=object)

    empty = F.array().cast("array<string>")
    return found(F.coalesce(old, empty), F.coalesce(new, empty))


def removed(found: Column) -> Column:
    """How many lines hunks remove."""
    return F.aggregate(F.flatten(F.transform(found, lambda h: h["edits"])), F.lit(0).cast("long"), lambda n, e: n + e["removed"])


def added(found: Column) -> Column:
    """How many lines hunks add."""
    return F.aggregate(F.flatten(F.transform(found, lambda h: h["edits"])), F.lit(0).cast("long"), lambda n, e: n + e["added"])


def patch(found: Column, old: Column, new: Column) -> Column:
    """Hunks as text in unified form, each line with its end; empty without hunks."""
    part = lambda rows, start, n, sign: F.transform(F.slice(rows, start + 1, n), lambda x: F.concat(F.lit(sign), x))
    span = lambda at, n: F.concat((at + F.when(n > 0, 1).otherwise(0)).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))

    def body(h: Column) -> Column:
        last = F.element_at(h["edits"], -1)
        end = last["old"] + last["removed"]
        changes = F.flatten(F.transform(h["edits"], lambda e: F.concat(part(old, e["old"] - e["kept"], e["kept"], " "), part(old, e["old"], e["removed"], "-"), part(new, e["new"], e["added"], "+"))))
        head = F.concat(F.lit("@@ -"), span(h["old"], h["old_lines"]), F.lit(" +"), span(h["new"], h["new_lines"]), F.lit(" @@"))
        return F.array_join(F.concat(F.array(head), changes, part(old, end, h["old"] + h["old_lines"] - end, " "), F.array(F.lit(""))), "\n")

    return F.array_join(F.transform(found, body), "")
