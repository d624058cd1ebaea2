"""Streaming forms of the append-only history: deduplication, state chains and rates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeworks.sources.snapshots import shared_folder


def history_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    return spark.readStream.schema(schema).json(path)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now: it runs until its sources are read, and its rows are read back from the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").outputMode("append").start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def first_events(events: DataFrame, fingerprint: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each fingerprint within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([fingerprint])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def illegal_transitions(events: DataFrame, key: str, state: str, order: str, legal: dict[str, list[str]], first: list[str]) -> DataFrame:
    """Rows whose state may not follow the last one of their key, across batches: key, order, previous, state."""
    kinds = dict(events.dtypes)
    pairs = [("", s) for s in first] + [(a, b) for a, after in legal.items() for b in after]

    def step(own: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(order)[[order, state]]
        before = rows[state].shift()
        before.iloc[0] = held.get[0] if held.exists else None
        held.update((rows[state].iloc[-1],))
        fine = pd.MultiIndex.from_arrays([before.fillna(""), rows[state]]).isin(pairs)
        out = rows[~fine].assign(**{key: own[0], "previous": before[~fine]})
        yield out[[key, order, "previous", state]]

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, previous string, {state} string", "last string", "append", GroupStateTimeout.NoTimeout)
