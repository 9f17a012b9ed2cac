"""Timelines as streams: windowed counts, sessions, and a fold that keeps each slot's last state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, like: DataFrame, *, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of `like`; `ts` becomes an instant, as watermarks need."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def counts(stream: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events by window and type; events later than `late` behind the newest are dropped."""
    over = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(over.alias("window"), "event_type").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with no gap longer than `gap`."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("n"))


def fold_slots(stream: DataFrame) -> DataFrame:
    """The display list as it changes: rows (`timeline`, `slot`, `idx`, `kind`, `character`) in, each slot's state out.

    State is kept per (timeline, slot), so a long timeline is spread over tasks. Rows of one trigger are put in order;
    a row older than what the state has seen is left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("idx")
        seen, character = state.get if state.exists else (-1, None)
        for idx, kind, own in zip(rows["idx"], rows["kind"], rows["character"], strict=True):
            if idx <= seen:
                continue
            seen = int(idx)
            if kind == "remove":
                character = None
            elif not pd.isna(own):
                character = int(own)
        state.update((seen, character))
        yield pd.DataFrame({"timeline": [key[0]], "slot": [key[1]], "idx": [seen], "character": pd.array([character], dtype="Int64")})

    out = "timeline long, slot long, idx long, character long"
    return stream.groupBy("timeline", "slot").applyInPandasWithState(step, out, "seen long, character long", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(result: DataFrame, name: str, mode: str = "append", **options: Any) -> DataFrame:
    """Runs a stream over what is there now and gives the collected rows; for tests and small reports."""
    writer = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.start().awaitTermination()
    return result.sparkSession.table(name)
