"""Bars and beats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_onset(notes: DataFrame) -> DataFrame:
    """score_id, max_tick: the latest onset of a score."""
    return notes.groupBy("score_id").agg(F.max("time").alias("max_tick"))


def _ticks(signatures: DataFrame, tpq: DataFrame, ends: DataFrame, bars: bool) -> DataFrame:
    """Starts of bars or beats of each section of a time signature; a section runs to the next one, the last to the score's end."""
    along = Window.partitionBy("score_id").orderBy("time")
    s = signatures.where("num > 0 and den > 0").groupBy("score_id", "time").agg(F.max_by(F.struct("num", "den"), F.struct("num", "den")).alias("s")).select("score_id", "time", "s.*")
    s = s.withColumn("until", F.lead("time").over(along)).join(ends, "score_id").join(tpq, "score_id")
    end = F.col("max_tick") + (1 if bars else 0)
    s = s.withColumn("until", F.least(F.coalesce("until", end), end))
    step = F.floor(F.col("tpq") * 4 / F.col("den")).cast("bigint") * (F.col("num") if bars else F.lit(1))
    s = s.withColumn("step", step).where("until > time and step > 0")
    return s.select("score_id", "num", "den", "step", F.explode(F.sequence(F.col("time"), F.col("until") - 1, F.col("step"))).alias("tick"))


def bars(signatures: DataFrame, tpq: DataFrame, ends: DataFrame) -> DataFrame:
    """score_id, bar (from 0), tick, num, den. ends: (score_id, max_tick); a bar starts at or before max_tick. Unsupported signatures
    (null or not positive) are skipped; a score without signatures has no rows here (normalize_signatures gives it 4/4)."""
    return _ticks(signatures, tpq, ends, True).select("score_id", (F.row_number().over(Window.partitionBy("score_id").orderBy("tick")) - 1).cast("bigint").alias("bar"), "tick", "num", "den")


def beats(signatures: DataFrame, tpq: DataFrame, ends: DataFrame) -> DataFrame:
    """score_id, beat (from 0), tick: beats start before max_tick."""
    return _ticks(signatures, tpq, ends, False).select("score_id", (F.row_number().over(Window.partitionBy("score_id").orderBy("tick")) - 1).cast("bigint").alias("beat"), "tick")


def with_bar(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """Notes with the bar that they start in: an as-of join by one window over both, without a range join."""
    marks = bars.select("score_id", F.col("tick").alias("time"), F.lit(0).alias("_kind"), "bar", F.col("tick").alias("bar_tick"))
    d = notes.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True).repartition("score_id")
    along = Window.partitionBy("score_id").orderBy("time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("bar", "bar_tick"):
        d = d.withColumn(c, F.last(c, True).over(along))
    return d.where("_kind = 1").drop("_kind")


def notes_per_bar(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """score_id, bar, n_notes of every bar, 0 included."""
    n = with_bar(notes.select("score_id", "time"), bars).groupBy("score_id", "bar").agg(F.count("*").alias("n"))
    return bars.select("score_id", "bar").join(n, ["score_id", "bar"], "left").select("score_id", "bar", F.coalesce("n", F.lit(0)).alias("n_notes"))


def segment_bars(signatures: DataFrame, tpq: DataFrame, ends: DataFrame) -> DataFrame:
    """score_id, bar, start_tick, end_tick: bars that cover all ticks up to the end of the score (end_tick of the last is at or after it)."""
    b = _ticks(signatures, tpq, ends.withColumn("max_tick", F.col("max_tick") - 1), True)
    along = Window.partitionBy("score_id").orderBy("tick")
    return b.select("score_id", (F.row_number().over(along) - 1).cast("bigint").alias("bar"), F.col("tick").alias("start_tick"), F.coalesce(F.lead("tick").over(along), F.col("tick") + F.col("step")).alias("end_tick"))
