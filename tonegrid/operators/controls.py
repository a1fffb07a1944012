"""Attribute controls: what a bar or a track is like, as tokens. Notes on the grid; bars of `bar` positions from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.functions import uniform
from tonegrid.operators.preprocess import TRACK

#: The durations that have a control, in positions of a grid of 8 a beat.
LENGTHS = {"Whole": 32, "Half": 16, "Quarter": 8, "Eight": 4, "Sixteenth": 2}


def bars_with_notes(notes: DataFrame, bar: int) -> DataFrame:
    """Notes with their bar, of the bars that get controls: those with more than one note, and the last bar of a track."""
    d = notes.withColumn("bar", F.floor(F.col("time") / bar))
    n = d.groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    last = n.groupBy(*TRACK).agg(F.max("bar").alias("last"))
    kept = n.join(last, TRACK).where("n > 1 or bar = last").select(*TRACK, "bar")
    return d.join(kept, [*TRACK, "bar"], "left_semi")


def bar_onset_polyphony(d: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """score_id, track_idx, bar, min_polyphony, max_polyphony: notes of an onset, clamped."""
    n = d.groupBy(*TRACK, "bar", "time").agg(F.count("*").alias("n"))
    clamp = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)).cast("bigint")
    return n.groupBy(*TRACK, "bar").agg(clamp(F.min("n")).alias("min_polyphony"), clamp(F.max("n")).alias("max_polyphony"))


def bar_pitch_classes(d: DataFrame) -> DataFrame:
    """score_id, track_idx, bar, pitch_class of those that sound in the bar."""
    return d.select(*TRACK, "bar", (F.col("pitch") % 12).alias("pitch_class")).distinct()


def bar_note_density(d: DataFrame, most: int = 18) -> DataFrame:
    """score_id, track_idx, bar, density: the number of notes, '18+' from most on."""
    n = d.groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    return n.select(*TRACK, "bar", F.when(F.col("n") >= most, f"{most}+").otherwise(F.col("n").cast("string")).alias("density"))


def note_durations(d: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and a column for each of LENGTHS: 1 if a note lasts so long, else 0."""
    return d.groupBy(*keys).agg(*[F.max((F.col("duration") == n).cast("int")).alias(name.lower()) for name, n in LENGTHS.items()])


def track_onset_polyphony(notes: DataFrame, low: int = 1, high: int = 6) -> DataFrame:
    """score_id, track_idx, min_polyphony (always the least of the range), max_polyphony."""
    n = notes.groupBy(*TRACK, "time").agg(F.count("*").alias("n"))
    return n.groupBy(*TRACK).agg(F.lit(low).cast("bigint").alias("min_polyphony"), F.greatest(F.lit(low), F.least(F.lit(high), F.max("n"))).cast("bigint").alias("max_polyphony"))


def track_note_density(notes: DataFrame, bar: int, most: int = 18) -> DataFrame:
    """score_id, track_idx, min_density, max_density: notes a bar from bar 0 to the track's last, capped at most."""
    n = notes.withColumn("bar", F.floor(F.col("time") / bar)).groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    d = n.groupBy(*TRACK).agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("k"), F.max("bar").alias("last"))
    least = F.when(F.col("k") <= F.col("last"), 0).otherwise(F.col("a"))  # a bar without notes
    return d.select(*TRACK, F.least(least, F.lit(most)).cast("bigint").alias("min_density"), F.least(F.col("b"), F.lit(most)).cast("bigint").alias("max_density"))


def track_repetition(notes: DataFrame, bar: int, reach: int = 4, bins: int = 10) -> DataFrame:
    """score_id, track_idx, similarity, repetition: how many onset and offset cells of a bar recur in each of the next reach - 1 bars that have notes,
    as a share of its cells, averaged over the pairs; repetition is the nearest of `bins` values from 0 to 1.

    A cell is joined with the bars it is compared with by equality (each cell stands for reach - 1 of them), never by range.
    """
    d = notes.withColumn("bar", F.floor(F.col("time") / bar))
    on = F.struct(F.lit(0).alias("kind"), F.col("bar"), (F.col("time") % bar).alias("at"))
    end = F.col("time") + F.col("duration")
    off = F.struct(F.lit(1).alias("kind"), F.floor(end / bar).alias("bar"), (end % bar).alias("at"))
    cells = d.select(*TRACK, "pitch", F.explode(F.array(on, off)).alias("c")).select(*TRACK, "pitch", "c.*").distinct()
    bars = cells.select(*TRACK, "bar").distinct()
    sizes = cells.groupBy(*TRACK, "bar").agg(F.count("*").alias("n"))
    later = sizes.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, reach)]))).withColumn("other", F.col("bar") + F.col("step"))
    pairs = later.join(bars.withColumnRenamed("bar", "other"), [*TRACK, "other"])
    ahead = cells.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, reach)]))).withColumn("other", F.col("bar") + F.col("step"))
    shared = ahead.join(cells.withColumnRenamed("bar", "other"), [*TRACK, "other", "pitch", "kind", "at"]).groupBy(*TRACK, "bar", "other").agg(F.count("*").alias("s"))
    d = pairs.join(shared, [*TRACK, "bar", "other"], "left").groupBy(*TRACK).agg(F.sum(F.coalesce("s", F.lit(0)) / F.col("n")).alias("x"), F.count("*").alias("k"))
    similarity = F.round(F.col("x") / F.col("k"), 9)
    return d.select(*TRACK, similarity.alias("similarity"), F.floor(similarity * (bins - 1) + 0.5).alias("repetition"))


def random_indexes(bars: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """score_id, track_idx, bar: a seeded sample of round(share * n) of each track's bars, the same on any partitioning."""
    from pyspark.sql import Window

    u = uniform(seed, *TRACK, "bar")
    rank = F.row_number().over(Window.partitionBy(*TRACK).orderBy(u, "bar"))
    n = F.count("*").over(Window.partitionBy(*TRACK))
    return bars.withColumn("_r", rank).withColumn("_n", n).where(F.col("_r") <= F.rint(F.col("_n") * share)).select(*TRACK, "bar")
