"""Streaming twins of the stateful operators. Checkpoints go below the shared folder unless a place is given."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.workspace import scratch_path

c = F.col


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are dropped and state is cleared behind it."""
    stamped = events.withColumn("_at", c(time).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", width), *keys).agg(F.count("*").alias("n")).select(c("window.start").alias("window_start"), *keys, "n")


def latest_ratings(events: DataFrame) -> DataFrame:
    """Changes of each (user_id, business_id): the new rating, its t and review_id, and the rating it retracts.

    The rating of a pair is its last change, the one with the greatest (t, review_id); see :func:`current_ratings`.

    ``events`` has user_id, business_id, review_id, stars, t. State is one row a pair. An event that is older than the
    held one, by (t, review_id), or a repeated delivery of it, changes nothing.
    """
    state = "t timestamp_ntz, review_id string, stars double"
    out = "user_id string, business_id string, t timestamp_ntz, review_id string, stars double, retracted double"

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        best = held.get if held.exists else None
        old = best[2] if best else None
        changed = False
        for part in parts:
            for row in part.sort_values(["t", "review_id"]).itertuples():
                if best is None or (row.t, row.review_id) > (best[0], best[1]):
                    best, changed = (row.t, row.review_id, float(row.stars)), True
        if changed and best is not None:
            held.update(best)
            yield pd.DataFrame([(key[0], key[1], *best, old)], columns=["user_id", "business_id", "t", "review_id", "stars", "retracted"])

    rows = events.select("user_id", "business_id", "review_id", c("stars").cast("double").alias("stars"), c("t").cast("timestamp_ntz").alias("t"))
    return rows.groupBy("user_id", "business_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def current_ratings(changes: DataFrame) -> DataFrame:
    """(user_id, business_id, stars) after all ``changes`` of :func:`latest_ratings`, in whatever batches they came."""
    return changes.groupBy("user_id", "business_id").agg(F.max_by("stars", F.struct("t", "review_id")).alias("stars"))


def upsert_batches(stream: DataFrame, out: str, checkpoint: str | None = None) -> None:
    """Runs a stream in update mode over all that is available now; each micro-batch is a folder ``batch=N`` of ``out``.

    Update mode keeps the watermark's promise: late rows are dropped and state behind it is cleared. A batch that runs
    again overwrites its own folder.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()


def last_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the latest batch of :func:`upsert_batches`."""
    rest = [n for n in updates.columns if n not in keys and n != "batch"]
    return updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("x")).select(*keys, *(c(f"x.{n}") for n in rest))


def drain(stream: DataFrame, out: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over all that is available now into a Parquet folder, with a durable checkpoint."""
    place = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", place).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
