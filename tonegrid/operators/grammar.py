"""Token grammars: notes on the grid to tokens and back.

Notes: score_id, track_idx, program, is_drum, time, duration, pitch, velocity on a grid of config.tpb positions a quarter, bars of four quarters.
A track's notes are ordered by time, duration, pitch, velocity. Each encoder sorts once per track and counts places with a running sum over the same
window, so there is one shuffle by (score_id, track_idx). Tracks without notes have no tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig, vocabulary
from tonegrid.functions import greedy, nearest_bin, span_name
from tonegrid.operators.notes import pair_notes
from tonegrid.operators.preprocess import NOTE_ORDER, TRACK


def _token(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), value.cast("string"))


def _pitch(melodic: str = "Pitch", drum: str = "PitchDrum") -> Column:
    return F.when(F.col("is_drum"), _token(drum, F.col("pitch"))).otherwise(_token(melodic, F.col("pitch")))


def _note_tokens(config: GridConfig) -> list[Column]:
    return [_pitch(), _token("Velocity", F.col("velocity")), _token("Duration", span_name(F.col("duration"), config.durations))]


def _placed(d: DataFrame, keys: list[str], order: list[str], tokens: Column, out: str = "token") -> DataFrame:
    """Explodes the token array of each row; ord counts from 1 along the keys."""
    along = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumn("_tokens", tokens)
    d = d.withColumn("_base", F.coalesce(F.sum(F.size("_tokens")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.select(*keys, "_base", F.posexplode("_tokens").alias("_i", out))
    return d.select(*keys, (F.col("_base") + F.col("_i") + 1).cast("bigint").alias("ord"), out)


def _timed(notes: DataFrame, config: GridConfig, keys: list[str] = TRACK, order: list[str] = NOTE_ORDER) -> DataFrame:
    """Adds bar, position, the onset before (_last, null at the start) and the bar before (_bar, -1 at the start)."""
    size = 4 * config.tpb
    along = Window.partitionBy(*keys).orderBy(*order)
    d = notes.withColumn("_last", F.lag("time").over(along))
    bar = F.floor(F.col("time") / F.lit(size))
    return d.withColumn("bar", bar).withColumn("position", F.col("time") % size).withColumn("_bar", F.coalesce(F.floor(F.col("_last") / F.lit(size)), F.lit(-1)))


def _new_onset() -> Column:
    return ~F.col("_last").eqNullSafe(F.col("time"))


def _if(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast("array<string>"))


def encode_remi(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Bar tokens up to the bar of each new onset, its Position, then Pitch, Velocity, Duration: (score_id, track_idx, ord, token)."""
    d = _timed(notes, config)
    bars = F.array_repeat(F.lit("Bar_None"), (F.col("bar") - F.col("_bar")).cast("int"))
    return _placed(d, TRACK, NOTE_ORDER, F.concat(bars, _if(_new_onset(), _token("Position", F.col("position"))), F.array(*_note_tokens(config))))


def encode_tsd(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """TimeShifts (largest first) to each new onset, then Pitch, Velocity, Duration."""
    d = _timed(notes, config)
    lengths = [n for n, _ in config.durations]
    shifts = F.transform(greedy(F.col("time") - F.coalesce("_last", F.lit(0)), lengths), lambda n: _token("TimeShift", span_name(n, config.durations)))
    return _placed(d, TRACK, NOTE_ORDER, F.concat(shifts, F.array(*_note_tokens(config))))


def encode_midilike(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """NoteOn, Velocity and NoteOff events with TimeShifts between them; at a time the events of earlier notes come first."""
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    d = notes.withColumn("_note", F.row_number().over(along))
    on = F.struct(F.col("time").alias("at"), F.lit(0).alias("off"), F.array(_pitch("NoteOn", "DrumOn"), _token("Velocity", F.col("velocity"))).alias("tokens"))
    off = F.struct((F.col("time") + F.col("duration")).alias("at"), F.lit(1).alias("off"), F.array(_pitch("NoteOff", "DrumOff")).alias("tokens"))
    d = d.select(*TRACK, "_note", F.inline(F.array(on, off)))
    order = ["at", "_note", "off"]
    d = d.withColumn("_last", F.lag("at", 1, 0).over(Window.partitionBy(*TRACK).orderBy(*order)))
    shifts = F.transform(greedy(F.col("at") - F.col("_last"), [n for n, _ in config.durations]), lambda n: _token("TimeShift", span_name(n, config.durations)))
    return _placed(d, TRACK, order, F.concat(shifts, "tokens"))


def encode_structured(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """TimeShift (the nearest one, 0.0.1 for none), Pitch, Velocity, Duration for each note."""
    d = _timed(notes, config)
    shift = F.col("time") - F.coalesce("_last", F.lit(0))
    near = span_name(nearest_bin(shift, sorted({n for n, _ in config.durations})), config.durations)
    return _placed(d, TRACK, NOTE_ORDER, F.array(_token("TimeShift", F.when(shift == 0, "0.0.1").otherwise(near)), *_note_tokens(config)))


def encode_octuple(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """One row a note: pitch, position, bar (the last one for later bars), velocity, duration tokens. No shift and no running state."""
    d = _timed(notes, config)
    pitch, velocity, duration = _note_tokens(config)
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    bar = _token("Bar", F.least(F.col("bar"), F.lit(config.max_bar_embedding - 1)))
    return d.select(*TRACK, F.row_number().over(along).cast("bigint").alias("ord"), pitch.alias("pitch"), _token("Position", F.col("position")).alias("position"), bar.alias("bar"), velocity.alias("velocity"), duration.alias("duration"))


_WORD = ["family", "position", "pitch", "velocity", "duration"]


def encode_cpword(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Compound rows family, position, pitch, velocity, duration: a metric row for each bar and each new onset, a note row for each note."""
    d = _timed(notes, config)
    none = F.lit("Ignore_None")
    word = lambda *x: F.concat_ws(" ", *x)
    bars = F.array_repeat(word(F.lit("Family_Metric"), F.lit("Bar_None"), none, none, none), (F.col("bar") - F.col("_bar")).cast("int"))
    onset = _if(_new_onset(), word(F.lit("Family_Metric"), _token("Position", F.col("position")), none, none, none))
    d = _placed(d, TRACK, NOTE_ORDER, F.concat(bars, onset, F.array(word(F.lit("Family_Note"), none, *_note_tokens(config)))), "word")
    parts = F.split("word", " ")
    return d.select(*TRACK, "ord", *[parts[i].alias(c) for i, c in enumerate(_WORD)])


def encode_mumidi(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """One stream a score, by time and track: rows token, bar, position, velocity, duration; a Program row where the track changes, at each onset anew."""
    order = ["time", "track_idx", "duration", "pitch", "velocity"]
    keys = ["score_id"]
    d = _timed(notes, config, keys, order)
    along = Window.partitionBy(*keys).orderBy(*order)
    d = d.withColumn("_track", F.lag("track_idx").over(along))
    last = config.max_bar_embedding - 1
    bar = _token("BarPosEnc", F.least(F.col("bar"), F.lit(last)))
    position = _token("PositionPosEnc", F.col("position"))
    none = F.lit("-")
    word = lambda *x: F.concat_ws(" ", *x)
    fresh = _new_onset()
    first = F.col("_bar") + 1
    bars = F.when(F.col("bar") > F.col("_bar"), F.transform(F.sequence(first, F.greatest(first, F.col("bar"))), lambda b: word(F.lit("Bar_None"), _token("BarPosEnc", F.least(b, F.lit(last))), F.lit("PositionPosEnc_None"), none, none))).otherwise(F.array().cast("array<string>"))
    onset = _if(fresh, word(_token("Position", F.col("position")), bar, position, none, none))
    program = _if(fresh | ~F.col("_track").eqNullSafe(F.col("track_idx")), word(_token("Program", F.col("program")), bar, position, none, none))
    pitch, velocity, duration = _note_tokens(config)
    d = _placed(d, keys, order, F.concat(bars, onset, program, F.array(word(pitch, bar, position, velocity, duration))), "word")
    parts = F.split("word", " ")
    names = ["token", "bar", "position", "velocity", "duration"]
    return d.select("score_id", "ord", *[F.when(parts[i] != "-", parts[i]).alias(c) for i, c in enumerate(names)])


def encode_mmm(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """One sequence a score: each track's encode_remi() tokens between Track_Start, Program and Track_End, tracks in their order."""
    body = encode_remi(notes, config)
    ends = notes.groupBy(*TRACK).agg(F.min("program").alias("program"))
    head = F.array(F.struct(F.lit(-2).cast("bigint").alias("ord"), F.lit("Track_Start").alias("token")), F.struct(F.lit(-1).cast("bigint").alias("ord"), _token("Program", F.col("program")).alias("token")), F.struct(F.lit((1 << 62)).alias("ord"), F.lit("Track_End").alias("token")))
    d = body.unionByName(ends.select(*TRACK, F.inline(head))).repartition("score_id")
    along = Window.partitionBy("score_id").orderBy("track_idx", "ord")
    return d.select("score_id", F.row_number().over(along).cast("bigint").alias("ord"), "track_idx", "token")


def encode_pertok(notes: DataFrame, tpq: int = 220, micro: float = 0.25, bins: int = 110, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes on a fine grid of tpq a quarter: Bar, Position on the coarse grid, MicroTiming (the nearest bin of what is left, the lower of
    two equally near), Pitch, Velocity, Duration in ticks; every note has its Position."""
    size = 4 * config.tpb
    step, reach = tpq / config.tpb, micro * tpq
    d = notes.withColumn("_coarse", F.rint(F.col("time") / F.lit(step)).cast("bigint"))
    order = ["_coarse", *NOTE_ORDER]
    along = Window.partitionBy(*TRACK).orderBy(*order)
    d = d.withColumn("bar", F.floor(F.col("_coarse") / size)).withColumn("_bar", F.coalesce(F.floor(F.lag("_coarse").over(along) / size), F.lit(-1)))
    left = F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col("time") - F.col("_coarse") * F.lit(step)))
    width = 2 * reach / (bins - 1)
    bin_ = F.ceil((left + F.lit(reach)) / F.lit(width) - F.lit(0.5))
    tokens = F.array(_token("Position", F.col("_coarse") % size), _token("MicroTiming", F.greatest(bin_, F.lit(0)).cast("bigint")), _pitch(), _token("Velocity", F.col("velocity")), _token("Duration", F.col("duration")))
    return _placed(d, TRACK, order, F.concat(F.array_repeat(F.lit("Bar_None"), (F.col("bar") - F.col("_bar")).cast("int")), tokens))


ENCODERS = {
    "remi": encode_remi, "tsd": encode_tsd, "midilike": encode_midilike, "structured": encode_structured, "octuple": encode_octuple,
    "cpword": encode_cpword, "mumidi": encode_mumidi, "mmm": encode_mmm,
}


def vocabulary_rows(spark, grammar: str, config: GridConfig = DEFAULT) -> DataFrame:
    """vocab_idx, token, id of a grammar; as many rows as the configuration has tokens."""
    rows = [(i, t, j) for i, tokens in enumerate(vocabulary(grammar, config)) for j, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "vocab_idx int, token string, id int")


def token_ids(tokens: DataFrame, vocab: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Adds id; a token that isn't in the vocabulary has none. The vocabulary is a fixed table and is broadcast."""
    return tokens.join(F.broadcast(vocab.select("token", "id")), "token", "left").select(*keys, "ord", "token", "id")


def sequences(tokens: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """The tokens (and ids, where there are) of each sequence as arrays in order; for storing whole sequences."""
    own = [c for c in ("token", "id") if c in tokens.columns]
    d = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *own))).alias("_s"))
    return d.select(*keys, *[F.col(f"_s.{c}").alias(f"{c}s") for c in own])


# decoding ---------------------------------------------------------------------------------------------------------------------------------


def _value(column: str = "token") -> Column:
    return F.substring_index(column, "_", -1)


def _kind(column: str = "token") -> Column:
    return F.substring_index(column, "_", 1)


def _length(value: Column, config: GridConfig) -> Column:
    """Positions of a duration value beats.positions.resolution."""
    p = F.split(value, r"\.")
    return (p[0].cast("bigint") * config.tpb + F.floor(p[1].cast("bigint") * config.tpb / p[2].cast("bigint"))).cast("bigint")


def _notes_at(tokens: DataFrame, keys: list[str], time: Column, config: GridConfig) -> DataFrame:
    """Notes of Pitch, Velocity, Duration triples; a pitch that isn't followed by both is skipped."""
    along = Window.partitionBy(*keys).orderBy("ord")
    d = tokens.withColumn("_time", time)
    for i, kind in ((1, "Velocity"), (2, "Duration")):
        ahead = F.lead("token", i).over(along)
        d = d.withColumn(f"_{kind}", F.when(_kind_of(ahead) == kind, F.substring_index(ahead, "_", -1)))
    d = d.where(_kind().isin("Pitch", "PitchDrum") & F.col("_Velocity").isNotNull() & F.col("_Duration").isNotNull())
    return d.select(*keys, (_kind() == "PitchDrum").alias("is_drum"), F.col("_time").alias("time"), _length(F.col("_Duration"), config).alias("duration"), _value().cast("int").alias("pitch"), F.col("_Velocity").cast("bigint").alias("velocity"))


def _kind_of(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def decode_remi(tokens: DataFrame, config: GridConfig = DEFAULT, keys: list[str] = TRACK) -> DataFrame:
    """Notes of encode_remi() tokens: the bar is the running number of Bar tokens, the position the last one seen. No fold."""
    upto = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.sum((_kind() == "Bar").cast("bigint")).over(upto) - 1
    position = F.last(F.when(_kind() == "Bar", 0).when(_kind() == "Position", _value().cast("bigint")), True).over(upto)
    return _notes_at(tokens, keys, F.greatest(bar, F.lit(0)) * (4 * config.tpb) + F.coalesce(position, F.lit(0)), config)


def _elapsed(keys: list[str], config: GridConfig) -> Column:
    upto = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    shift = F.when((_kind() == "TimeShift") & (_value() != "0.0.1"), _length(_value(), config)).otherwise(0)
    return F.sum(shift).over(upto)


def decode_tsd(tokens: DataFrame, config: GridConfig = DEFAULT, keys: list[str] = TRACK) -> DataFrame:
    """Notes of encode_tsd() or encode_structured() tokens: time is the running sum of the shifts."""
    return _notes_at(tokens, keys, _elapsed(keys, config), config)


def decode_midilike(tokens: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of encode_midilike() tokens; ons and offs of a pitch are paired first with first, unended notes are left out."""
    along = Window.partitionBy(*TRACK).orderBy("ord")
    d = tokens.withColumn("tick", _elapsed(TRACK, config)).withColumn("_v", F.lead("token").over(along))
    d = d.where(_kind().isin("NoteOn", "NoteOff", "DrumOn", "DrumOff"))
    on = _kind().isin("NoteOn", "DrumOn")
    d = d.select(*TRACK, "ord", "tick", F.when(on, "NoteOn").otherwise("NoteOff").alias("event_type"), F.when(_kind().startswith("Drum"), 9).otherwise(0).alias("channel"), _value().cast("int").alias("pitch"), F.when(on, _value("_v").cast("int")).alias("velocity"))
    return pair_notes(d).select(*TRACK, (F.col("channel") == 9).alias("is_drum"), F.col("tick").alias("time"), "duration", "pitch", F.col("velocity").cast("bigint").alias("velocity"))


def decode_octuple(rows: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of encode_octuple() rows."""
    time = _value("bar").cast("bigint") * (4 * config.tpb) + _value("position").cast("bigint")
    return rows.select(*TRACK, (_kind("pitch") == "PitchDrum").alias("is_drum"), time.alias("time"), _length(_value("duration"), config).alias("duration"), _value("pitch").cast("int").alias("pitch"), _value("velocity").cast("bigint").alias("velocity"))


def decode_cpword(rows: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of encode_cpword() rows."""
    upto = Window.partitionBy(*TRACK).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    bar = F.sum((F.col("position") == "Bar_None").cast("bigint")).over(upto) - 1
    position = F.last(F.when(F.col("position") == "Bar_None", 0).when(_kind("position") == "Position", _value("position").cast("bigint")), True).over(upto)
    d = rows.withColumn("time", bar * (4 * config.tpb) + position).where("family = 'Family_Note'")
    return d.select(*TRACK, (_kind("pitch") == "PitchDrum").alias("is_drum"), "time", _length(_value("duration"), config).alias("duration"), _value("pitch").cast("int").alias("pitch"), _value("velocity").cast("bigint").alias("velocity"))


def decode_mumidi(rows: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of encode_mumidi() rows: score_id, program, is_drum, time, duration, pitch, velocity."""
    upto = Window.partitionBy("score_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("program", F.last(F.when(_kind() == "Program", _value().cast("int")), True).over(upto)).where("velocity is not null")
    time = _value("bar").cast("bigint") * (4 * config.tpb) + _value("position").cast("bigint")
    return d.select("score_id", "program", (_kind() == "PitchDrum").alias("is_drum"), time.alias("time"), _length(_value("duration"), config).alias("duration"), _value().cast("int").alias("pitch"), _value("velocity").cast("bigint").alias("velocity"))


# tokens -----------------------------------------------------------------------------------------------------------------------------------


def token_errors(tokens: DataFrame, edges: list[tuple[str, str]], keys: list[str] = TRACK) -> DataFrame:
    """(*keys, n_tokens, n_type_errors, n_time_errors, n_note_errors): types that may not follow, positions that don't advance in their
    bar, pitches that come twice at an onset. edges: the type graph; a table of the grammar."""
    along = Window.partitionBy(*keys).orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    graph = F.array(*[F.lit(f"{a}>{b}") for a, b in edges])
    d = tokens.withColumn("_kind", _kind()).withColumn("_last", F.lag(_kind()).over(along))
    wrong = F.col("_last").isNotNull() & ~F.array_contains(graph, F.concat_ws(">", "_last", "_kind"))
    d = d.withColumn("_wrong", wrong).withColumn("_bar", F.sum((F.col("_kind") == "Bar").cast("bigint")).over(upto))
    d = d.withColumn("_onset", F.sum(F.col("_kind").isin("Bar", "Position", "TimeShift").cast("bigint")).over(upto))
    d = d.withColumn("_position", F.when(F.col("_kind") == "Position", _value().cast("int")))
    in_bar = Window.partitionBy(*keys, "_bar").orderBy("ord")
    d = d.withColumn("_back", F.coalesce(F.col("_position") <= F.max("_position").over(in_bar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    at = Window.partitionBy(*keys, "_onset", "token").orderBy("ord")
    d = d.withColumn("_twice", F.col("_kind").isin("Pitch", "PitchDrum") & (F.row_number().over(at) > 1))
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    return d.groupBy(*keys).agg(F.count("*").alias("n_tokens"), n("_wrong").alias("n_type_errors"), n("_back").alias("n_time_errors"), n("_twice").alias("n_note_errors"))


def universal_vocabulary(vocabs: DataFrame, n: int) -> DataFrame:
    """token, id, shared of a vocabulary over several grammars: tokens of all grammars first, sorted, then each grammar's own, then a
    mark of each grammar. vocabs: (grammar, token) of n grammars. Each token has one id."""
    own = vocabs.groupBy("token").agg(F.count_distinct("grammar").alias("k"), F.min("grammar").alias("g"))
    own = own.select("token", (F.col("k") == n).alias("shared"), F.when(F.col("k") == n, "").otherwise(F.col("g")).alias("g"), F.lit(0).alias("mark"))
    marks = vocabs.select("grammar").distinct().select(F.concat(F.lit("<"), "grammar", F.lit(">")).alias("token"), F.lit(False).alias("shared"), F.col("grammar").alias("g"), F.lit(1).alias("mark"))
    order = Window.orderBy("mark", "g", "token")  # a vocabulary: a table of fixed size
    return own.unionByName(marks).select("token", (F.row_number().over(order) - 1).cast("bigint").alias("id"), "shared")
