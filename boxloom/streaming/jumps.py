"""Incremental use: detection files as a stream, windowed counts, and the largest jump of each track so far."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def detection_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of boxes as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def frame_counts(boxes: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Boxes and mean confidence per shot and time window; rows later than `late` are not waited for."""
    return boxes.withWatermark(time, late).groupBy(F.window(time, window), "shot_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Carries the last box that set a record, and the record."""
    held = state.get if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["frame", "x", "y"])
    for b in rows.itertuples(index=False):
        cx, cy, side = b.x + b.w / 2, b.y + b.h / 2, math.sqrt(b.w * b.h)
        if held is None:
            held = (float(b.frame), cx, cy, 0.0)
            continue
        span = side * (b.frame - held[0])
        ratio = math.hypot(cx - held[1], cy - held[2]) / span if span else 0.0
        if ratio > held[3]:
            held = (float(b.frame), cx, cy, ratio)
    state.update(held)
    yield pd.DataFrame([(*key, held[3])], columns=["shot_id", "track_id", "max_jump"])


def stream_max_jump(boxes: DataFrame) -> DataFrame:
    """(shot_id, track_id, max_jump) of a stream of tracked boxes, updated with each batch; as operators.detections.max_jump.

    The frames of a track must come in order from batch to batch; within a batch they may come in any order.
    """
    rows = boxes.select("shot_id", "track_id", "frame", "x", "y", "w", "h")
    state = "f double, cx double, cy double, ratio double"
    return rows.groupBy("shot_id", "track_id").applyInPandasWithState(_fold, "shot_id long, track_id long, max_jump double", state, "update", GroupStateTimeout.NoTimeout)
