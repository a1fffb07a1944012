"""A whole score on its grid: signatures, notes, tempos, pedals and bends, in the fixed order in which one depends on the other.

A score's grid is as fine as its finest time signature needs; a section under a coarser one keeps to every second (fourth, ...) position. So a score has
an array of its few sections, and every time is looked up in it in the JVM: no range join, and no window over the events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.functions import nearest_bin
from tonegrid.operators import harmony, preprocess
from tonegrid.operators.preprocess import TRACK
from tonegrid.session import materialize


@dataclass(frozen=True)
class Switches:
    """Which tokens a sequence has beside those of notes, and whether a score is one sequence."""

    signatures: bool = False
    tempos: bool = False
    rests: bool = False
    programs: bool = False
    one_stream: bool = False
    program_changes: bool = False
    pedals: bool = False
    pedal_durations: bool = False
    bends: bool = False
    chords: bool = False
    intervals: bool = False
    bar_ends: bool = False
    note_offs: bool = False

    def __post_init__(self):
        if (self.one_stream or self.program_changes) and not self.programs:
            raise ValueError("one stream and program changes need programs")


@dataclass(frozen=True)
class Prepared:
    """Tables on the grid, notes with the step of their section; sections: (score_id, tpq, s), s being an array of (time, bar, num, den) by time."""

    sections: DataFrame
    notes: DataFrame
    tempos: DataFrame
    pedals: DataFrame
    bends: DataFrame
    signatures: DataFrame


def grids(signatures: DataFrame, tpq: DataFrame, config: GridConfig = DEFAULT, by_signature: bool = True) -> DataFrame:
    """score_id, old, tpq: the resolution of a score, and that of its grid: config.tpb, or more where its supported signatures have denominators above 4."""
    if not by_signature:
        return tpq.select("score_id", F.col("tpq").alias("old"), F.lit(config.tpb).alias("tpq"))
    finest = preprocess.supported_signatures(signatures, config).groupBy("score_id").agg(F.max("den").alias("den"))
    new = (F.lit(config.tpb) * F.greatest(F.lit(4), F.coalesce("den", F.lit(4))) / 4).cast("int")
    return tpq.join(finest, "score_id", "left").select("score_id", F.col("tpq").alias("old"), new.alias("tpq"))


def sections(signatures: DataFrame, grid: DataFrame, config: GridConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The normalized signatures of each score of `grid`, on its grid, and (score_id, old, tpq, s) with the array of its sections."""
    own = preprocess.supported_signatures(signatures, config).join(grid, "score_id")
    own = own.select("score_id", F.floor(F.col("time") * F.col("tpq") / F.col("old")).alias("time"), "num", "den").distinct()
    fixed = preprocess.normalize_signatures(own, grid.select("score_id", "tpq"), True)
    along = Window.partitionBy("score_id").orderBy("time")
    d = fixed.join(grid.select("score_id", "tpq"), "score_id")
    bars = (F.lead("time").over(along) - F.col("time")) / (F.floor(F.col("tpq") * 4 / F.col("den")) * F.col("num"))
    d = d.withColumn("bars", bars).withColumn("bar", F.coalesce(F.sum("bars").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    s = d.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("time", "bar", "num", "den"))).alias("s"))
    return fixed, grid.join(s, "score_id")


def section_at(time: Column, array: str = "s") -> Column:
    """The section of a time; the first one for times before it."""
    return F.coalesce(F.element_at(F.filter(array, lambda x: x["time"] <= time), -1), F.element_at(array, 1))


def on_grid(d: DataFrame, sections: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """d with `time` on the grid of its score and of its section, half to even; keeps s, tpq and old of the score."""
    d = d.join(sections, "score_id").withColumn("_g", F.rint(F.col("time") * F.col("tpq") / F.col("old")).cast("bigint"))
    d = d.withColumn("_f", step_of(section_at(F.col("_g")), config))
    return d.withColumn("time", (F.rint(F.col("_g") / F.col("_f")) * F.col("_f")).cast("bigint")).drop("_g", "_f")


def step_of(section: Column, config: GridConfig = DEFAULT) -> Column:
    """Positions of the score's grid that are one position of the section's."""
    return F.greatest(F.lit(1), F.floor(F.col("tpq") * 4 / section["den"] / config.tpb))


def nearest_duration(duration: Column, step: Column, config: GridConfig = DEFAULT) -> Column:
    """The duration of the table nearest to so many positions of the score, in those positions; of two equally near the longer."""
    lengths = sorted({n for n, _ in config.durations})
    x = duration / step
    if lengths == [*range(1, 33), *range(34, 97, 2)]:  # the default table in closed form
        return (F.when(x < 33, F.least(F.lit(32), F.greatest(F.lit(1), F.floor(x + 0.5)))).otherwise(F.least(F.lit(96), F.floor(x / 2 + 0.5) * 2)) * step).cast("bigint")
    return (nearest_bin(F.floor(x + 0.5), lengths) * step).cast("bigint")


def _lasting(d: DataFrame, quantized: bool, config: GridConfig) -> DataFrame:
    """Durations on the grid: those of the table (of the section where they begin), or, if ends are events of their own, rounded in that section, one
    position at least, and rounded anew where they end if that is another section."""
    d = d.withColumn("_d", F.greatest(F.lit(1), F.rint(F.col("duration") * F.col("tpq") / F.col("old")).cast("bigint"))).withColumn("_f", step_of(section_at(F.col("time")), config))
    if quantized:
        return d.withColumn("duration", nearest_duration(F.col("_d"), F.col("_f"), config)).drop("_d", "_f")
    d = d.withColumn("_d", (F.greatest(F.lit(1), F.rint(F.col("_d") / F.col("_f"))) * F.col("_f")).cast("bigint"))
    d = d.withColumn("_e", step_of(section_at(F.col("time") + F.col("_d")), config))
    end = (F.rint((F.col("time") + F.col("_d")) / F.col("_e")) * F.col("_e")).cast("bigint")
    return d.withColumn("duration", F.when(F.col("_e") == F.col("_f"), F.col("_d")).otherwise(F.greatest(F.col("_e"), end - F.col("time")))).drop("_d", "_f", "_e")


def prepare(notes: DataFrame, scores_tpq: DataFrame, tracks: DataFrame, signatures: DataFrame, tempos: DataFrame, pedals: DataFrame, bends: DataFrame, switches: Switches = Switches(), config: GridConfig = DEFAULT) -> Prepared:
    """A score's tables, ready to be written as tokens: supported signatures, the grid, times on it, same programs merged (one stream), signatures on bar starts,
    pitch range, velocities, times and durations by section, pedals merged, bends and tempos quantized, each in this order.

    Notes and sections are written to the shared folder, once: every kind of item reads them again, and pairing notes is the dear part.

    Tracks without a row in `tracks` are melodic with program 0. Scores without a resolution are left out. What a switch leaves out is empty.
    """
    grid = grids(signatures, scores_tpq, config, switches.signatures)
    fixed, own = sections(signatures if switches.signatures else signatures.where("false"), grid, config)
    own = materialize(own)
    fixed = own.select("score_id", F.inline("s")).select("score_id", "time", "num", "den")
    drum = F.coalesce("is_drum", F.lit(False))
    kinds = tracks.select(*TRACK, drum.alias("is_drum"), F.when(drum, -1).otherwise(F.coalesce("program", F.lit(0))).alias("program"))
    if switches.one_stream:
        first = kinds.groupBy("score_id", "program").agg(F.min("track_idx").alias("_first"))
        kinds = kinds.join(first, ["score_id", "program"])
    else:
        kinds = kinds.withColumn("_first", F.col("track_idx"))

    def of_track(d: DataFrame) -> DataFrame:
        d = d.join(kinds, TRACK, "left").withColumn("is_drum", F.coalesce("is_drum", F.lit(False))).withColumn("program", F.coalesce("program", F.lit(0)))
        return d.withColumn("track_idx", F.coalesce("_first", "track_idx")).drop("_first")

    n = preprocess.quantize_velocity(preprocess.in_pitch_range(of_track(notes), config), config)
    n = _lasting(on_grid(n, own, config), not switches.note_offs, config)
    n = materialize(n.select(*TRACK, "program", "is_drum", "time", "duration", "pitch", "velocity", step_of(section_at(F.col("time")), config).cast("bigint").alias("step")))
    here = own.select("score_id", F.lit(config.tpb).alias("tpq"))  # times are on the grid already
    t = preprocess.quantize_tempos(on_grid(tempos, own, config).select("score_id", "time", "usec"), here, config) if switches.tempos else None
    p = b = None
    if switches.pedals:
        p = _lasting(on_grid(of_track(pedals), own, config), False, config)
        p = preprocess.merge_pedals(p.select(*TRACK, "time", "duration")).join(own, "score_id")
        if switches.pedal_durations:
            p = p.withColumn("duration", nearest_duration(F.col("duration"), step_of(section_at(F.col("time")), config), config))
        p = p.select(*TRACK, "time", "duration")
    if switches.bends:
        b = preprocess.quantize_bends(on_grid(of_track(bends), own, config).select(*TRACK, "ord", "time", "value"), here, config)
    none = notes.select(*TRACK, F.lit(0).cast("bigint").alias("time"), F.lit(0).cast("bigint").alias("duration"), F.lit(0).cast("bigint").alias("value"), F.lit(0.0).alias("tempo")).where("false")
    return Prepared(
        own,
        n,
        t if t is not None else none.select("score_id", "time", "tempo"),
        p if p is not None else none.select(*TRACK, "time", "duration"),
        b if b is not None else none.select(*TRACK, "time", "value"),
        fixed if switches.signatures else fixed.where("false"),
    )


def program_rows(prepared: Prepared) -> DataFrame:
    """score_id, track_idx, program, is_drum of the tracks that have notes."""
    return prepared.notes.select(*TRACK, "program", "is_drum").distinct()


def chord_rows(prepared: Prepared, config: GridConfig = DEFAULT) -> DataFrame:
    """Chords of the melodic tracks, without their roots; on the grid of the section's beats."""
    return harmony.chords(prepared.notes.where("not is_drum"), config.tpb, root=False)


