"""Content identities."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha(value: Column, chars: int = 64) -> Column:
    """The first hex digits of the SHA-256 of a string."""
    return F.substring(F.sha2(value, 256), 1, chars)


def composite_id(prefix: str, *parts: Column, chars: int = 16) -> Column:
    """prefix-hash of parts joined by NUL."""
    return F.concat(F.lit(f"{prefix}-"), sha(F.concat_ws("\0", *parts), chars))


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of fields joined by U+001F, nulls as empty strings."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)


def canonical_json(*columns: str) -> Column:
    """One JSON text of the columns in the order of their names, with nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


#: Rows, and digests, that one digest is made of on average, at most, when they meet in one array.
FAN = 4096


def _digest_of(members: Column | str) -> Column:
    """SHA-256 of the sorted members (k, d) as lines k:d."""
    return F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(members)), lambda x: F.concat_ws(":", x["k"], x["d"]))), 256)


def _running(batches):
    """SHA-256 of the lines of each run of rows with equal first columns; the last column is the line. Only the digest so far is kept."""
    now = own = None
    for batch in batches:
        *keys, lines = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        kinds, done = batch.schema, []
        for *key, line in zip(*keys, lines, strict=True):
            if key != now:
                if own is not None:
                    done.append([*now, own.hexdigest()])
                now, own = key, hashlib.sha256(line.encode())
            else:
                own.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(kinds)], schema=kinds)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*now, own.hexdigest()], kinds, strict=True)], schema=kinds)


def root_hash(df: DataFrame, key: str, row_digest: Column, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """An order-free digest of many rows, or of the rows of each group, made level by level along the hex digits of the keys' hashes.

    The lowest level's groups share two digits, or four, six, ... as the number of rows asks for, so that no task gets
    more than some FAN rows of one group; each further level folds 256 groups into one. digits: that number, given where
    the digest must not depend on the number of rows; of large groups the sorted lines are then read one after the
    other, so that no group is ever whole in memory.
    """
    n, by, given = df.count(), by or [], digits
    digits = given or 2
    while not given and n > FAN * 16**digits:
        digits += 2
    rows = df.select(*by, sha(F.col(key).cast("string"), digits).alias("g"), F.col(key).cast("string").alias("k"), row_digest.alias("d"))
    if n <= FAN * 16**digits:
        level = rows.groupBy(*by, "g").agg(_digest_of(F.struct("k", "d")).alias("d"))
    else:
        lines = rows.repartition(256, *by, "g").sortWithinPartitions(*by, "g", "k", "d").select(*by, "g", F.concat_ws(":", "k", "d").alias("d"))
        level = lines.mapInArrow(_running, lines.schema)
    for digits in range(digits - 2, 0, -2):
        level = level.groupBy(*by, F.substring("g", 1, digits).alias("h")).agg(_digest_of(F.struct(F.col("g").alias("k"), "d")).alias("d")).select(*by, F.col("h").alias("g"), "d")
    return level.groupBy(*by).agg(_digest_of(F.struct(F.col("g").alias("k"), "d")).alias("root_hash"))
