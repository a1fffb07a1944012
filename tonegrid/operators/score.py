"""Scores: tables of notes, effects and meta events from raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.notes import pair_notes


def raw_once(raw: DataFrame) -> DataFrame:
    """Raw events once per (score_id, track_idx, ord): the row loaded first."""
    first = Window.partitionBy("score_id", "track_idx", "ord").orderBy("loaded_at")
    return raw.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def once_loaded(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small table once per key: the one loaded first."""
    first = Window.partitionBy(*keys).orderBy("loaded_at")
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def notes(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, time, duration, pitch, velocity of all notes; their order is time, duration, pitch, velocity."""
    return pair_notes(raw).select("score_id", "track_idx", F.col("tick").alias("time"), "duration", "pitch", "velocity")


def pedals(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, time, duration: controller 64 from a value of at least 64 to the next one below, first with first in each channel."""
    pedal = raw.where("event_type = 'ControlChange' and controller = 64 and value is not null")
    as_notes = pedal.withColumn("event_type", F.when(F.col("value") >= 64, "NoteOn").otherwise("NoteOff")).withColumn("velocity", F.lit(1)).withColumn("pitch", F.lit(0))
    return pair_notes(as_notes).select("score_id", "track_idx", F.col("tick").alias("time"), "duration")


def meta(raw: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """Distinct (score_id, time, values) of the meta events of a kind, over all tracks; events without tick are left out."""
    rows = raw.where((F.col("event_type") == kind) & F.col("tick").isNotNull())
    return rows.select("score_id", F.col("tick").alias("time"), *[F.col(a).alias(b) for b, a in columns.items()]).distinct()


def tempos(raw: DataFrame) -> DataFrame:
    """score_id, time, usec (of a quarter)."""
    return meta(raw, "Tempo", {"usec": "usec_per_quarter"})


def time_signatures(raw: DataFrame) -> DataFrame:
    """score_id, time, num, den."""
    return meta(raw, "TimeSignature", {"num": "numerator", "den": "denominator"})


def key_signatures(raw: DataFrame) -> DataFrame:
    """score_id, time, key, tonality."""
    return meta(raw, "KeySignature", {"key": "key", "tonality": "scale"})


def pitch_bends(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, ord, time, value from -8192 to 8191."""
    return raw_once(raw).where("event_type = 'PitchBend' and tick is not null").select("score_id", "track_idx", "ord", F.col("tick").alias("time"), (F.col("value") - 8192).alias("value"))


def controls(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, ord, time, number, value of the control changes other than pedals."""
    rows = raw_once(raw).where("event_type = 'ControlChange' and tick is not null and controller <> 64")
    return rows.select("score_id", "track_idx", "ord", F.col("tick").alias("time"), F.col("controller").alias("number"), "value")


def programs(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, program: the first program change of a track, 0 without one, -1 (drums) if its first channel is 9."""
    d = raw.groupBy("score_id", "track_idx").agg(
        F.min_by("program", F.when(F.col("event_type") == "ProgramChange", F.col("ord"))).alias("p"),
        F.min_by("channel", F.when(F.col("channel").isNotNull(), F.col("ord"))).alias("c"),
    )
    return d.select("score_id", "track_idx", F.when(F.col("c") == 9, -1).otherwise(F.coalesce("p", F.lit(0))).alias("program"))


def track_order(raw: DataFrame) -> DataFrame:
    """score_id, track_idx, pos, ord, tick, event_type: a track's events by tick, EndOfTrack last, note-offs before note-ons at a tick."""
    on = (F.col("event_type") == "NoteOn") & (F.coalesce("velocity", F.lit(0)) > 0)
    along = Window.partitionBy("score_id", "track_idx").orderBy((F.col("event_type") == "EndOfTrack").cast("int"), "tick", F.when(on, 1).otherwise(0), "ord")
    d = raw_once(raw).where("tick is not null")
    return d.select("score_id", "track_idx", F.row_number().over(along).cast("bigint").alias("pos"), "ord", "tick", "event_type")


def merge_by_program(raw: DataFrame) -> DataFrame:
    """score_id, program, pos, track_idx, ord, tick, event_type: the events of all tracks of a program as one track, in the order of track_order()."""
    on = (F.col("event_type") == "NoteOn") & (F.coalesce("velocity", F.lit(0)) > 0)
    d = raw_once(raw).where("tick is not null").drop("program").join(programs(raw), ["score_id", "track_idx"])
    along = Window.partitionBy("score_id", "program").orderBy((F.col("event_type") == "EndOfTrack").cast("int"), "tick", F.when(on, 1).otherwise(0), "track_idx", "ord")
    return d.select("score_id", "program", F.row_number().over(along).cast("bigint").alias("pos"), "track_idx", "ord", "tick", "event_type")
