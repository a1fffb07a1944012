"""Streams of note events: windows of activity, and tokens as tracks end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(events: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """start, event_type, n: events loaded in each window; rows later than `late` behind the watermark are left out. For readStream and read alike."""
    d = events.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return d.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def distinct_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events once per (score_id, track_idx, ord) within the watermark; keys older than that are forgotten, so the state is bounded."""
    d = events.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", late)
    return d.dropDuplicatesWithinWatermark(["score_id", "track_idx", "ord"])


def pair_stream(events: DataFrame, idle: str = "7 days") -> DataFrame:
    """score_id, track_idx, channel, pitch, tick, duration: notes as soon as their note-off arrives; the queue of open note-ons of a key is its state. A key for which
    nothing was loaded until the watermark is `idle` further gives up its open notes with a duration of 1. Rows without loaded_at are left out. Events of a key must arrive in the order of ord, as a file's do; those of a micro-batch are sorted."""
    key = ["score_id", "track_idx", "channel", "pitch"]
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_: list[int] = list(state.get[0]) if state.exists else []
        out: list[tuple[int, int]] = []
        if state.hasTimedOut:
            out = [(t, 1) for t in open_]
            state.remove()
        else:
            batch = pd.concat(list(rows)).sort_values("ord")
            for tick, on in zip(batch["tick"], batch["on"]):
                if on:
                    open_.append(int(tick))
                elif open_:
                    start = open_.pop(0)
                    out.append((start, max(1, int(tick) - start)))
            state.update((open_,))
            state.setTimeoutTimestamp(max(int(batch["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(*k, *x) for x in out], columns=[*key, "tick", "duration"])

    on = (F.col("event_type") == "NoteOn") & (F.coalesce("velocity", F.lit(0)) > 0)
    if "at" not in events.columns:
        events = events.withColumn("at", F.col("loaded_at").cast("timestamp")).withWatermark("at", idle)
    d = events.where("event_type in ('NoteOn', 'NoteOff') and tick is not null and pitch is not null and channel is not null and at is not null").select(*key, "ord", "tick", on.alias("on"), "at")
    return d.groupBy(*key).applyInPandasWithState(step, "score_id long, track_idx int, channel int, pitch int, tick long, duration long", "open array<long>", "append", GroupStateTimeout.EventTimeTimeout)
