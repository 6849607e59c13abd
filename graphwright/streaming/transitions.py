"""Structured Streaming forms: transition graphs of event windows, and running moments of trials."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..graph import Graph

STEP = "user_id long, ts timestamp, previous string, event_type string"


def steps(events: DataFrame) -> DataFrame:
    """(user_id, ts, previous, event_type): each event after the one before it of its user, in order of arrival; state is the last type and time of each user.

    An event older than its user's last is counted from it, but doesn't become the last.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
            if last is not None:
                out.append((key[0], ts, last, kind))
            if at is None or ts.value >= at:
                last, at = kind, ts.value
        state.update((last, at))
        yield pd.DataFrame(out, columns=["user_id", "ts", "previous", "event_type"])

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(run, STEP, "last string, at long", "append", GroupStateTimeout.NoTimeout)


def windowed_transitions(transitions: DataFrame, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, previous, event_type, weight) of transitions(ts, previous, event_type), a stream or a table; later events than the watermark drop from streams."""
    df = transitions.withWatermark("ts", late) if transitions.isStreaming else transitions
    return df.groupBy(F.window("ts", window), "previous", "event_type").agg(F.count("*").cast("double").alias("weight"))


def running_moments(samples: DataFrame) -> DataFrame:
    """(graph_id, node, n, mean, std, min, max) of samples as they come (update or complete mode), or of a table."""
    return samples.groupBy("graph_id", "node").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def each_batch(graphs: Callable[[DataFrame], Graph], analyse: Callable[[Graph], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows to graphs, graphs to a result, the result to a sink."""
    return lambda rows, number: sink(analyse(graphs(rows)), number)
