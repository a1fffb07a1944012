"""From scores in their own resolution to scores on the grid of a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.functions import nearest, nearest_bin, resampled, velocity_bin

TRACK = ["score_id", "track_idx"]
NOTE_ORDER = ["time", "duration", "pitch", "velocity"]


def resample(notes: DataFrame, tpq: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Times and durations on the grid, half to even; a duration is at least 1. tpq: (score_id, tpq), one row a score."""
    d = notes.join(tpq, "score_id").where("tpq > 0")
    time, duration = resampled(F.col("time"), F.col("tpq"), config.tpb), resampled(F.col("duration"), F.col("tpq"), config.tpb)
    return d.withColumn("time", time).withColumn("duration", F.greatest(F.lit(1), duration)).drop("tpq")


def in_pitch_range(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes within the range of their kind, both ends included; needs is_drum, null meaning no drums."""
    drum = F.coalesce(F.col("is_drum"), F.lit(False))
    return notes.where(F.when(drum, F.col("pitch").between(*config.drum_range)).otherwise(F.col("pitch").between(*config.pitch_range)))


def quantize_velocity(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    return notes.withColumn("velocity", velocity_bin(F.col("velocity"), config.velocities))


def quantize_duration(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Durations of the table, the longer of two that are equally near."""
    lengths = sorted({n for n, _ in config.durations})
    if lengths == [*range(1, 33), *range(34, 97, 2)]:  # the default table in closed form
        d = F.col("duration")
        return notes.withColumn("duration", F.when(d <= 32, d).when(d >= 96, 96).otherwise(d + d % 2).cast("bigint"))
    return notes.withColumn("duration", nearest_bin(F.col("duration"), lengths))


def drop_duplicates(notes: DataFrame, same_duration: bool = False) -> DataFrame:
    """Of the notes of a track with equal time and pitch (and duration) the first by duration and velocity."""
    keys = [*TRACK, "time", "pitch"] + ["duration"] * same_duration
    first = Window.partitionBy(*keys).orderBy("duration", "velocity")
    return notes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fix_overlaps(notes: DataFrame) -> DataFrame:
    """A note ends at the latest where the next note of its pitch starts."""
    along = Window.partitionBy(*TRACK, "pitch").orderBy("time", "duration", "velocity")
    d = notes.withColumn("_next", F.lead("time").over(along))
    return d.withColumn("duration", F.when(F.col("_next") <= F.col("time") + F.col("duration"), F.col("_next") - F.col("time")).otherwise(F.col("duration"))).drop("_next")


def numbered(notes: DataFrame) -> DataFrame:
    """Adds ord, the place of a note in its track; notes that are equal in all of NOTE_ORDER are interchangeable."""
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    return notes.withColumn("ord", F.row_number().over(along).cast("bigint"))


def preprocess(notes: DataFrame, scores: DataFrame, tracks: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes on the grid: score_id, track_idx, program, is_drum, time, duration, pitch, velocity.

    Tracks without a row in `tracks` are melodic with program 0; scores without a resolution are left out; tracks left without notes disappear.
    """
    d = notes.join(tracks.select(*TRACK, "program", "is_drum"), TRACK, "left")
    d = d.withColumn("is_drum", F.coalesce("is_drum", F.lit(False))).withColumn("program", F.when(F.col("is_drum"), -1).otherwise(F.coalesce("program", F.lit(0))))
    d = quantize_duration(quantize_velocity(resample(in_pitch_range(d, config), scores.select("score_id", "tpq"), config), config), config)
    return d.select(*TRACK, "program", "is_drum", "time", "duration", "pitch", "velocity")


def target_tpq(signatures: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, tpq: positions of a quarter that the finest denominator of a score needs, config.tpb for denominators up to 4."""
    return signatures.groupBy("score_id").agg((F.lit(config.tpb) * F.greatest(F.lit(4), F.max("den")) / 4).cast("bigint").alias("tpq"))


def supported_signatures(signatures: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Signatures that the configuration has tokens for; the table of them is part of the configuration."""
    known = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(d).alias("den")) for n, d in config.time_signatures])
    return signatures.where(F.array_contains(known, F.struct(F.col("num").cast("int").alias("num"), F.col("den").cast("int").alias("den"))))


def normalize_signatures(signatures: DataFrame, tpq: DataFrame, every: bool = False) -> DataFrame:
    """score_id, time, num, den: equal successive signatures once, each delayed to the next bar start of the one before, the last of
    a tick kept, and 4/4 at 0 where a score starts without one. every: scores of tpq without signatures have 4/4 too. A fold over the few
    signatures of a score, in the JVM."""
    rows = F.array_sort(F.collect_list(F.struct("time", "num", "den")))
    d = tpq.join(signatures.groupBy("score_id").agg(rows.alias("s")), "score_id", "left" if every else "inner")
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("time"), F.lit(4).alias("num"), F.lit(4).alias("den")))

    def step(acc, s):
        last = F.element_at(acc, -1)
        bar = F.floor(F.col("tpq") * 4 / last["den"]).cast("bigint") * last["num"]
        at = last["time"] + F.ceil((s["time"] - last["time"]) / bar) * bar
        new = F.array(F.struct(at.cast("bigint").alias("time"), s["num"].alias("num"), s["den"].alias("den")))
        same = (s["num"] == last["num"]) & (s["den"] == last["den"])
        return F.when(same, acc).when(at <= last["time"], F.concat(F.slice(acc, 1, F.size(acc) - 1), new)).otherwise(F.concat(acc, new))

    return d.select("score_id", F.inline(F.coalesce(F.aggregate("s", start, step), start)))


def sections(signatures: DataFrame, tpq: DataFrame) -> DataFrame:
    """score_id, time, until (null for the last), ticks_per_beat: stretches of one beat length; equal successive ones are one."""
    along = Window.partitionBy("score_id").orderBy("time")
    d = signatures.groupBy("score_id", "time").agg(F.max_by("den", F.struct("den", "num")).alias("den")).join(tpq, "score_id")
    d = d.select("score_id", "time", F.floor(F.col("tpq") * 4 / F.col("den")).cast("bigint").alias("ticks_per_beat"))
    d = d.withColumn("_b", F.lag("ticks_per_beat").over(along)).where("_b is null or _b <> ticks_per_beat")
    return d.select("score_id", "time", F.lead("time").over(along).alias("until"), "ticks_per_beat")


def quantize_tempos(tempos: DataFrame, tpq: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, time, tempo: times on the grid, tempos of the table nearest in microseconds of a quarter; of a tick the last, equal successive
    ones once if the configuration says so, and the default tempo at 0 where a score starts without one."""
    table = sorted((60e6 / t, t) for t in config.tempos)
    d = tempos.join(tpq, "score_id").where("tpq > 0 and usec > 0")
    d = d.select("score_id", resampled(F.col("time"), F.col("tpq"), config.tpb).alias("time"), F.col("time").alias("_t"), "usec")
    value = F.lit(table[-1][1])
    for (a, x), (b, _) in reversed(list(zip(table, table[1:]))):
        value = F.when(F.col("usec") * 2 < F.lit(a + b), F.lit(x)).otherwise(value)
    d = d.groupBy("score_id", "time").agg(F.max_by("usec", F.struct("_t", "usec")).alias("usec")).select("score_id", "time", value.alias("tempo"))
    along = Window.partitionBy("score_id").orderBy("time")
    first = d.groupBy("score_id").agg(F.min("time").alias("m")).where("m > 0").select("score_id", F.lit(0).cast("bigint").alias("time"), F.lit(config.default_tempo).alias("tempo"))
    d = d.unionByName(first).repartition("score_id")  # a window must not take the partitions of the union's sides for its own
    if config.drop_equal_tempos:
        d = d.withColumn("_b", F.lag("tempo").over(along)).where("_b is null or _b <> tempo").drop("_b")
    return d


def quantize_bends(bends: DataFrame, tpq: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, track_idx, time, value: bends of the table; of a tick the one furthest from 0, the first of equally far ones."""
    d = bends.join(tpq, "score_id").where("tpq > 0 and value is not null")
    d = d.select(*TRACK, "ord", resampled(F.col("time"), F.col("tpq"), config.tpb).alias("time"), nearest(F.col("value"), config.pitch_bends).cast("bigint").alias("value"))
    far = Window.partitionBy(*TRACK, "time").orderBy(F.abs("value").desc(), "ord")
    return d.withColumn("_n", F.row_number().over(far)).where("_n = 1").select(*TRACK, "time", "value")


def merge_pedals(pedals: DataFrame) -> DataFrame:
    """score_id, track_idx, time, duration: pedals of a track that overlap or touch are one."""
    from tonegrid.operators.intervals import periods_and_gaps

    d = pedals.withColumn("end", F.col("time") + F.col("duration"))
    return periods_and_gaps(d, TRACK, "time", "end").where("kind = 'period'").select(*TRACK, "time", (F.col("end") - F.col("time")).alias("duration"))


def empty_tracks(tracks: DataFrame, notes: DataFrame) -> DataFrame:
    """Tracks without a note."""
    return tracks.join(notes.select(*TRACK).distinct(), TRACK, "left_anti")
