"""Events beside the notes: signatures and tempos of a score, pedals and bends of a track; REMI with time signatures; errors of other grammars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.operators.grammar import _kind, _note_tokens, _token, _value
from tonegrid.operators.preprocess import NOTE_ORDER, TRACK


def grid_signatures(signatures: DataFrame, tpq: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Signatures with their times on the grid, cut to whole positions."""
    d = signatures.join(tpq, "score_id")
    return d.select("score_id", F.floor(F.col("time") * config.tpb / F.col("tpq")).alias("time"), "num", "den")


def global_events(signatures: DataFrame, tempos: DataFrame) -> DataFrame:
    """score_id, time, ord, type, value: TimeSig n/d and Tempo, by time, the signature first."""
    d = signatures.select("score_id", "time", F.lit(0).alias("_k"), F.lit("TimeSig").alias("type"), F.concat_ws("/", F.col("num").cast("string"), F.col("den").cast("string")).alias("value"))
    d = d.union(tempos.select("score_id", "time", F.lit(1), F.lit("Tempo"), F.format_string("%.2f", F.col("tempo"))))
    along = Window.partitionBy("score_id").orderBy("time", "_k", "value")
    return d.repartition("score_id").select("score_id", "time", F.row_number().over(along).cast("bigint").alias("ord"), "type", "value")


def effect_events(pedals: DataFrame, bends: DataFrame) -> DataFrame:
    """score_id, track_idx, time, type, value: Pedal and PedalOff at the ends of each pedal, PitchBend."""
    end = F.struct((F.col("time") + F.col("duration")).alias("time"), F.lit("PedalOff").alias("type"))
    d = pedals.select(*TRACK, F.inline(F.array(F.struct(F.col("time").alias("time"), F.lit("Pedal").alias("type")), end))).withColumn("value", F.lit("None"))
    return d.select(*TRACK, "time", "type", "value").union(bends.select(*TRACK, "time", F.lit("PitchBend"), F.col("value").cast("string")))


def encode_remi_signatures(notes: DataFrame, bars: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, track_idx, ord, token: REMI whose bars follow the score's time signatures; each Bar is followed by its TimeSig.

    notes have bar and bar_tick (grid.with_bar); bars: score_id, bar, tick, num, den. A track has all bars up to that of its last note, so Bar rows are the
    bars joined with the tracks by score, and no gap needs filling. Position counts from the start of the bar.
    """
    last = notes.groupBy(*TRACK).agg(F.max("bar").alias("last"))
    heads = bars.join(last, "score_id").where(F.col("bar") <= F.col("last"))
    sign = F.concat(F.lit("TimeSig_"), F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"))
    heads = heads.select(*TRACK, "bar", F.lit(0).cast("bigint").alias("_n"), F.array(F.lit("Bar_None"), sign).alias("_tokens"))
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    fresh = ~F.lag("time").over(along).eqNullSafe(F.col("time"))
    at = F.when(fresh, F.array(_token("Position", F.col("time") - F.col("bar_tick")))).otherwise(F.array().cast("array<string>"))
    d = notes.withColumn("_at", at).select(*TRACK, "bar", F.row_number().over(along).cast("bigint").alias("_n"), F.concat("_at", F.array(*_note_tokens(config))).alias("_tokens"))
    d = heads.union(d).repartition(*TRACK)
    order = Window.partitionBy(*TRACK).orderBy("bar", "_n")
    d = d.withColumn("_base", F.coalesce(F.sum(F.size("_tokens")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.select(*TRACK, "_base", F.posexplode("_tokens").alias("_i", "token"))
    return d.select(*TRACK, (F.col("_base") + F.col("_i") + 1).cast("bigint").alias("ord"), "token")


def midilike_errors(tokens: DataFrame) -> DataFrame:
    """score_id, track_idx, n_unstarted, n_unended: note-offs without an open note-on of their pitch, and note-ons never ended. With +1 and -1 the running sum's
    least value below 0 counts the former, and what remains above it the latter."""
    on, off = _kind().isin("NoteOn", "DrumOn"), _kind().isin("NoteOff", "DrumOff")
    d = tokens.where(on | off).select(*TRACK, "ord", _kind().startswith("Drum").alias("drum"), _value().alias("pitch"), F.when(on, 1).otherwise(-1).alias("d"))
    run = Window.partitionBy(*TRACK, "drum", "pitch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("s", F.sum("d").over(run)).groupBy(*TRACK, "drum", "pitch").agg(F.least(F.lit(0), F.min("s")).alias("m"), F.sum("d").alias("s"))
    return d.groupBy(*TRACK).agg(F.sum(-F.col("m")).alias("n_unstarted"), F.sum(F.col("s") - F.col("m")).alias("n_unended"))


def octuple_errors(rows: DataFrame) -> DataFrame:
    """score_id, track_idx, n_rows, n_errors: rows before their predecessor in time, or that repeat a pitch of their onset."""
    along = Window.partitionBy(*TRACK).orderBy("ord")
    d = rows.withColumn("at", _value("bar").cast("bigint") * 1000 + _value("position").cast("bigint"))
    same = Window.partitionBy(*TRACK, "at", "pitch").orderBy("ord")
    wrong = F.coalesce(F.col("at") < F.lag("at").over(along), F.lit(False)) | (F.row_number().over(same) > 1)
    return d.withColumn("_w", wrong.cast("bigint")).groupBy(*TRACK).agg(F.count("*").alias("n_rows"), F.sum("_w").alias("n_errors"))


def cpword_errors(rows: DataFrame) -> DataFrame:
    """score_id, track_idx, n_rows, n_errors: a position that doesn't advance in its bar, a note that repeats a pitch of its onset, a note before any position."""
    along = Window.partitionBy(*TRACK).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.sum((F.col("position") == "Bar_None").cast("bigint")).over(along)
    d = rows.withColumn("b", bar).withColumn("p", F.when(_kind("position") == "Position", _value("position").cast("int")))
    d = d.withColumn("o", F.sum(F.col("p").isNotNull().cast("bigint")).over(along)).withColumn("note", F.col("family") == "Family_Note")
    in_bar = Window.partitionBy(*TRACK, "b").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*TRACK, "o", "note", "pitch").orderBy("ord")
    wrong = F.coalesce(F.col("p") <= F.max("p").over(in_bar), F.lit(False)) | (F.col("note") & ((F.row_number().over(same) > 1) | (F.col("o") == 0)))
    return d.withColumn("_w", wrong.cast("bigint")).groupBy(*TRACK).agg(F.count("*").alias("n_rows"), F.sum("_w").alias("n_errors"))
