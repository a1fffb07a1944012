"""Whole sequences back to scores: notes with programs, tempos, signatures, pedals and bends; MMM and PerTok; errors of MuMIDI and MMM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.operators import grammar
from tonegrid.operators.grammar import _kind, _length, _value
from tonegrid.operators.preprocess import TRACK


def _part(value: Column, i: int) -> Column:
    return F.split(value, "/")[i].cast("bigint")


def _events(d: DataFrame, keys: list[str], config: GridConfig, own_program: bool) -> DataFrame:
    """(*keys, kind, program, time, a, b, c) of tokens with at (their time) and step: notes (duration, pitch, velocity), tempos (100 times their value), signatures
    (a/b), pedals (duration) and bends (value). own_program: a Program token stands before each note and bend, else the last one counts."""
    along = Window.partitionBy(*keys).orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(_kind() == "Program", _value().cast("bigint"))
    d = d.withColumn("program", F.last(named, True).over(upto) if not own_program else F.lag(named).over(along))
    for i, kind in ((1, "Velocity"), (2, "Duration")):
        ahead = F.lead("token", i).over(along)
        d = d.withColumn(f"_{kind}", F.when(F.substring_index(ahead, "_", 1) == kind, F.substring_index(ahead, "_", -1)))
    null = F.lit(None).cast("bigint")
    row = lambda kind, program, a, b=null, c=null: F.struct(F.lit(kind).alias("kind"), program.alias("program"), F.col("at").alias("time"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), c.cast("bigint").alias("c"))
    k, v = _kind(), _value()
    made = F.when(k.isin("Pitch", "PitchDrum") & F.col("_Velocity").isNotNull() & F.col("_Duration").isNotNull(), row("note", F.col("program"), _length(F.col("_Duration"), config) * F.col("step"), v, F.col("_Velocity")))
    made = made.when(k == "Tempo", row("tempo", null, F.rint(v.cast("double") * 100))).when((k == "TimeSig") & F.col("changes"), row("signature", null, _part(v, 0), _part(v, 1)))
    made = made.when(k == "PitchBend", row("bend", F.col("program"), v)).when(k == "Pedal", row("pedal", v.cast("bigint"), null)).when(k == "PedalOff", row("off", v.cast("bigint"), null))
    d = d.select(*keys, "ord", made.alias("m")).where("m is not null").select(*keys, "ord", "m.*")
    held = d.where("kind in ('pedal', 'off')")
    of = Window.partitionBy(*keys, "program").orderBy("ord")
    ends = F.first(F.when(F.col("kind") == "off", F.col("time")), True).over(of.rowsBetween(1, Window.unboundedFollowing))
    held = held.withColumn("a", ends - F.col("time")).where("kind = 'pedal' and a is not null")  # pedals of a program don't overlap
    out = [*keys, "kind", "program", "time", "a", "b", "c"]
    return d.where("kind not in ('pedal', 'off')").select(*out).unionByName(held.select(*out))


def _signed(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Adds sign (numerator, denominator of the last TimeSig so far, 4/4 before any), step (positions of the grid in one of the section), and changes: whether a
    TimeSig is another one than before, or the first."""
    along = Window.partitionBy(*keys).orderBy("ord")
    upto, above = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    sign = F.when(_kind() == "TimeSig", F.struct(_part(_value(), 0).alias("n"), _part(_value(), 1).alias("d")))
    d = tokens.withColumn("_sign", sign)
    finest = F.greatest(F.lit(4), F.coalesce(F.max("_sign.d").over(Window.partitionBy(*keys)), F.lit(4)))
    before = F.last("_sign", True).over(above)
    d = d.withColumn("_finest", finest).withColumn("changes", ~before.eqNullSafe(F.col("_sign")))
    d = d.withColumn("sign", F.coalesce(F.last("_sign", True).over(upto), F.struct(F.lit(4).cast("bigint").alias("n"), F.lit(4).cast("bigint").alias("d"))))
    return d.withColumn("step", (F.col("_finest") / F.col("sign.d")).cast("bigint"))


def restore_remi(tokens: DataFrame, keys: list[str], config: GridConfig = DEFAULT, own_program: bool = True) -> DataFrame:
    """(*keys, kind, program, time, a, b, c) of stream.encode_remi() sequences without rests: bars begin at the running sum of the bars before, each as long as its
    signature says; see _events(). No fold."""
    along = Window.partitionBy(*keys).orderBy("ord")
    upto, above = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    d = tokens.withColumn("_next", F.lead("token").over(along))
    # a Bar belongs to the signature that stands behind it, or else to the one before
    d = _signed(d, keys)
    own = F.when(F.substring_index("_next", "_", 1) == "TimeSig", F.struct(_part(F.substring_index("_next", "_", -1), 0).alias("n"), _part(F.substring_index("_next", "_", -1), 1).alias("d"))).otherwise(F.col("sign"))
    is_bar = F.col("token") == "Bar_None"
    size = F.when(is_bar, own["n"] * config.tpb * 4 * (F.col("_finest") / 4) / own["d"]).otherwise(0).cast("bigint")
    d = d.withColumn("_size", size).withColumn("_last", F.last(F.when(is_bar, F.col("_size")), True).over(upto))
    start = F.sum("_size").over(upto) - F.coalesce("_last", F.lit(0))
    position = F.last(F.when(is_bar, 0).when(_kind() == "Position", _value().cast("bigint")), True).over(upto)
    return _events(d.withColumn("at", (start + F.coalesce(position, F.lit(0)) * F.col("step")).cast("bigint")), keys, config, own_program)


def restore_tsd(tokens: DataFrame, keys: list[str], config: GridConfig = DEFAULT, own_program: bool = True) -> DataFrame:
    """(*keys, kind, program, time, a, b, c) of stream.encode_tsd() sequences without rests: time is the running sum of the shifts, each in positions of the
    section that it stands in."""
    upto = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = _signed(tokens, keys)
    shift = F.when(_kind() == "TimeShift", _length(_value(), config) * F.col("step")).otherwise(0)
    return _events(d.withColumn("at", F.sum(shift).over(upto).cast("bigint")), keys, config, own_program)


def decode_mmm(tokens: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, track (from 0, by order), program, is_drum, time, duration, pitch, velocity of grammar.encode_mmm() sequences: a track runs from its Track_Start, and
    the tokens between are decoded as REMI."""
    upto = Window.partitionBy("score_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = tokens.select("score_id", "ord", "token").withColumn("track", (F.sum((F.col("token") == "Track_Start").cast("bigint")).over(upto) - 1))
    d = d.withColumn("program", F.last(F.when(_kind() == "Program", _value().cast("int")), True).over(upto))
    keys = ["score_id", "track", "program"]
    body = d.where(~_kind().isin("Track", "Program"))
    return grammar.decode_remi(body, config, keys)


def decode_pertok(tokens: DataFrame, tpq: int = 220, micro: float = 0.25, bins: int = 110, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of grammar.encode_pertok() sequences, times to the nearest bin: score_id, track_idx, is_drum, time, duration, pitch, velocity."""
    along = Window.partitionBy(*TRACK).orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    size, step, reach = 4 * config.tpb, tpq / config.tpb, micro * tpq
    bar = F.sum((_kind() == "Bar").cast("bigint")).over(upto) - 1
    d = tokens.withColumn("_bar", bar)
    for back, kind in ((2, "Position"), (1, "MicroTiming")):
        d = d.withColumn(f"_{kind}", F.when(F.substring_index(F.lag("token", back).over(along), "_", 1) == kind, F.substring_index(F.lag("token", back).over(along), "_", -1).cast("bigint")))
    for ahead, kind in ((1, "Velocity"), (2, "Duration")):
        d = d.withColumn(f"_{kind}", F.substring_index(F.lead("token", ahead).over(along), "_", -1).cast("bigint"))
    d = d.where(_kind().isin("Pitch", "PitchDrum") & F.col("_Position").isNotNull() & F.col("_MicroTiming").isNotNull())
    at = (F.col("_bar") * size + F.col("_Position")) * F.lit(step) + F.col("_MicroTiming") * F.lit(2 * reach / (bins - 1)) - F.lit(reach)
    return d.select(*TRACK, (_kind() == "PitchDrum").alias("is_drum"), F.greatest(F.lit(0), F.rint(at)).cast("bigint").alias("time"), F.col("_Duration").alias("duration"), _value().cast("int").alias("pitch"), F.col("_Velocity").alias("velocity"))


def mumidi_errors(rows: DataFrame) -> DataFrame:
    """score_id, n_rows, n_errors: rows of encode_mumidi() whose bar or position goes back, and notes that repeat a pitch of their program at an onset."""
    along = Window.partitionBy("score_id").orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(_kind("position") == "PositionPosEnc", _value("bar").cast("bigint") * 1000 + F.coalesce(_value("position").try_cast("bigint"), F.lit(-1)))
    d = rows.withColumn("at", at).withColumn("p", F.last(F.when(_kind() == "Program", F.col("token")), True).over(upto))
    note = F.col("velocity").isNotNull()
    again = note & (F.row_number().over(Window.partitionBy("score_id", "at", "p", "token", note).orderBy("ord")) > 1)
    wrong = F.coalesce(F.col("at") < F.max("at").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) | again
    return d.withColumn("_w", wrong.cast("bigint")).groupBy("score_id").agg(F.count("*").alias("n_rows"), F.sum("_w").alias("n_errors"))


def mmm_errors(tokens: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """score_id, track, n_tokens, n_type_errors, n_time_errors, n_note_errors: the errors of each track's own tokens."""
    upto = Window.partitionBy("score_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = tokens.select("score_id", "ord", "token").withColumn("track", (F.sum((F.col("token") == "Track_Start").cast("bigint")).over(upto) - 1))
    return grammar.token_errors(d.where(~_kind().isin("Track", "Program")), edges, ["score_id", "track"])
