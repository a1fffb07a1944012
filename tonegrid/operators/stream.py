"""Sequences with all kinds of tokens: signatures, tempos, rests, programs, pedals, bends, chords and intervals beside the notes.

Everything that sounds or changes is an item: a time and the tokens that it adds, which stand together. Items are sorted once, by track or by score, and a
window over that order tells what must come before each: the time since the item before, the silence since the latest end, the bars that began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.functions import greedy, nearest_bin, span_name
from tonegrid.operators.grammar import _if, _pitch, _placed, _token
from tonegrid.operators.pipeline import Prepared, Switches, chord_rows, program_rows, section_at, step_of
from tonegrid.operators.preprocess import NOTE_ORDER, TRACK

#: The order of items: by time, then what concerns the whole score, then track by track pedals, bends, chords, notes, each in their own order.
ORDER = ["time", "rank", "whole", "track_idx", "part", "k0", "k1", "k2", "k3", "sub"]


def _none() -> Column:
    return F.array().cast("array<string>")


def _interval(reach: Column, most: int = 16) -> Column:
    """The first token of a note: PitchIntervalTime, PitchIntervalChord or its pitch; see harmony.pitch_intervals()."""
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    last_time, last = F.lag("time").over(along), F.lag("pitch").over(along)
    fresh = ~last_time.eqNullSafe(F.col("time"))
    jump, step = F.col("pitch") - F.col("_o"), F.col("pitch") - last
    token = F.when(fresh & (F.col("time") - last_time <= reach) & (F.abs(jump) <= most), _token("PitchIntervalTime", jump))
    return F.when(F.col("is_drum"), _pitch()).otherwise(token.when(~fresh & (F.abs(step) <= most), _token("PitchIntervalChord", step)).otherwise(_pitch()))


def items(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, track_idx, the columns of ORDER, kind, tokens, program, reach (until when it sounds), and tpq and s of the score."""
    none = F.lit(None).cast("int")
    program = _if(F.lit(switches.programs and not switches.program_changes), _token("Program", F.col("program")))

    def item(d: DataFrame, kind: str, part: int, tokens: Column, reach: Column, keys: list[Column], sub: int = 0, rank: int = 0, whole: int = 1) -> DataFrame:
        k = [*keys, *[F.lit(0)] * (4 - len(keys))]
        return d.select(
            *TRACK, F.col("time"), F.lit(rank).alias("rank"), F.lit(whole).alias("whole"), F.lit(part).alias("part"), *[c.cast("bigint").alias(f"k{i}") for i, c in enumerate(k)], F.lit(sub).alias("sub"),
            F.lit(kind).alias("kind"), tokens.alias("tokens"), F.col("program"), reach.cast("bigint").alias("reach"),
        )

    with_chords = switches.chords and switches.note_offs  # ends come before chords, so there what stands at a time is ranked
    rank = lambda n: n if with_chords else 0
    n = prepared.notes
    if switches.intervals:
        along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
        fresh = ~F.lag("time").over(along).eqNullSafe(F.col("time"))
        own = F.when(fresh | (F.abs(F.col("pitch") - F.lag("pitch").over(along)) > 16), F.col("pitch"))
        n = n.withColumn("_own", own).withColumn("_o", F.last("_own", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        n = n.withColumn("_first", _interval(F.col("step") * config.tpb))
    keys = [F.col(c) for c in NOTE_ORDER]
    first = F.col("_first") if switches.intervals else _pitch("NoteOn", "DrumOn") if switches.note_offs else _pitch()
    end = F.col("time") + F.col("duration")
    step = F.col("step")
    length = [] if switches.note_offs else [_token("Duration", span_name(F.floor(F.col("duration") / step), config.durations))]
    d = item(n, "Note", 3, F.concat(program, F.array(first, _token("Velocity", F.col("velocity")), *length)), end, keys, 0, rank(10))
    if switches.note_offs:
        off = n.withColumn("_t", F.col("time")).withColumn("time", end)
        d = d.union(item(off, "Off", 3, F.concat(program, F.array(_pitch("NoteOff", "DrumOff"))), F.lit(0), [F.col("_t"), *keys[1:]], 1, rank(1)))
    programs = program_rows(prepared)
    if switches.pedals:
        name = F.when(F.lit(switches.programs), F.col("program")).otherwise(0).cast("string")
        p = prepared.pedals.join(programs, TRACK)
        if switches.pedal_durations:
            p = p.join(prepared.sections.select("score_id", "tpq", "s"), "score_id").withColumn("step", step_of(section_at(F.col("time")), config))
        held = [_token("Duration", span_name(F.floor(F.col("duration") / step), config.durations))] if switches.pedal_durations else []
        d = d.union(item(p, "Pedal", 0, F.array(_token("Pedal", name), *held), F.col("time"), [F.col("time")], 0, rank(2)))
        if not switches.pedal_durations:
            over = p.withColumn("_t", F.col("time")).withColumn("time", end)
            d = d.union(item(over, "Pedal", 0, F.array(_token("PedalOff", name)), F.col("time"), [F.col("_t")], 1, rank(2)))
    if switches.bends:
        b = prepared.bends.join(programs, TRACK)
        d = d.union(item(b, "PitchBend", 1, F.concat(program, F.array(_token("PitchBend", F.col("value")))), F.col("time"), [F.col("time")], 0, rank(3)))
    if switches.chords:
        c = chord_rows(prepared, config).join(programs, TRACK)
        d = d.union(item(c, "Chord", 2, F.concat(program, F.array(_token("Chord", F.col("chord")))), F.col("time"), [F.col("time")], 0, rank(10)))
    sign = F.concat(F.lit("TimeSig_"), F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"))
    whole = [(prepared.signatures, "TimeSig", 0, sign)] if switches.signatures else []
    whole += [(prepared.tempos, "Tempo", 1, F.concat(F.lit("Tempo_"), _decimal(F.col("tempo"))))] if switches.tempos else []
    for rows, kind, part, token in whole:
        rows = rows.join(programs.select("score_id").distinct().withColumn("track_idx", F.lit(-1)) if switches.one_stream else programs.select(*TRACK), "score_id").withColumn("program", none)
        d = d.union(item(rows, kind, part, F.array(token), F.lit(0) if switches.note_offs and kind == "TimeSig" else F.col("time"), [], 0, 0, 0))
    return d.join(prepared.sections.select("score_id", "tpq", "s"), "score_id").repartition("score_id", *([] if switches.one_stream else ["track_idx"]))


def _decimal(x: Column) -> Column:
    """A number with up to two decimals, one at least."""
    return F.regexp_replace(F.format_string("%.2f", x), r"(\.\d)0$", "$1")


def _keys(switches: Switches) -> list[str]:
    return ["score_id"] if switches.one_stream else TRACK


def _ahead(d: DataFrame, keys: list[str], switches: Switches) -> DataFrame:
    """Adds what the items before tell: last (time), last_kind, reached, changed (a Program token where the program changes) and at_first."""
    along = Window.partitionBy(*keys).orderBy(*ORDER)
    above = along.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("last", F.lag("time").over(along)).withColumn("last_kind", F.lag("kind").over(along)).withColumn("reached", F.coalesce(F.max("reach").over(above), F.lit(0)))
    counts = F.col("kind").isin("Note", "Off", "PitchBend", "Chord")
    changed = _none()
    if switches.program_changes and switches.one_stream:
        before = F.last(F.when(counts, F.col("program")), True).over(above)
        changed = _if(counts & ~before.eqNullSafe(F.col("program")), _token("Program", F.col("program")))
    d = d.withColumn("changed", changed)
    head = _none()
    if switches.program_changes and not switches.one_stream:
        named = F.min("program").over(Window.partitionBy(*keys))
        head = _if(F.row_number().over(along) == 1, _token("Program", named))
    return d.withColumn("head", head)


def _units(d: DataFrame, config: GridConfig) -> DataFrame:
    """Adds where an item stands: bar, bar_tick, step; and before_step, that of the section which an item that changes it ends."""
    at, before = section_at(F.col("time")), section_at(F.when(F.col("kind") == "TimeSig", F.greatest(F.lit(0), F.col("time") - 1)).otherwise(F.col("time")))
    d = d.withColumn("_s", at).withColumn("_p", before).withColumn("step", step_of(F.col("_s"), config)).withColumn("before_step", step_of(F.col("_p"), config))
    long = F.floor(F.col("tpq") * 4 / F.col("_s.den")) * F.col("_s.num")
    d = d.withColumn("bar", (F.col("_s.bar") + F.floor((F.col("time") - F.col("_s.time")) / long)).cast("bigint"))
    return d.withColumn("bar_tick", (F.col("_s.time") + (F.col("bar") - F.col("_s.bar")) * long).cast("bigint"))


def _sign(section: str) -> Column:
    return F.concat(F.lit("TimeSig_"), F.col(f"{section}.num").cast("string"), F.lit("/"), F.col(f"{section}.den").cast("string"))


def _bar_of(time: Column) -> Column:
    s = section_at(time)
    return (s["bar"] + F.floor((time - s["time"]) / (F.floor(F.col("tpq") * 4 / s["den"]) * s["num"]))).cast("bigint")


def _silence(d: DataFrame, switches: Switches, config: GridConfig, placed: bool = True) -> DataFrame:
    """Adds rest_tokens, elapsed: how far the time tokens so far reach before this item (last, or the end of the rests), and fresh: whether its time must be
    said: it is another one, or (placed) a TimeSig has just been set."""
    apart = ~F.col("last").eqNullSafe(F.col("time"))
    if placed:
        apart = apart | F.coalesce(F.col("last_kind") == "TimeSig", F.lit(False))
    rests = F.array().cast("array<bigint>")
    if switches.rests:
        quiet = F.floor((F.col("time") - F.col("reached")) / F.col("before_step"))
        rests = F.when(apart & (quiet >= min(n for n, _ in config.rests)), greedy(quiet, [n for n, _ in config.rests])).otherwise(rests)
    d = d.withColumn("_rests", rests).withColumn("rest_tokens", F.transform("_rests", lambda n: _token("Rest", span_name(n, config.rests))))
    total = F.aggregate("_rests", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.withColumn("elapsed", F.when(F.size("_rests") > 0, F.col("reached") + total * F.col("before_step")).otherwise(F.col("last"))).withColumn("fresh", apart)


def encode_remi(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id[, track_idx], ord, token): before each item its Rests, the Bars that began (each with its TimeSig), and a Position if the time is another one
    or a TimeSig has just been set. Bars that lie wholly in a rest have no token. bar_ends: a Bar_End before each Bar but the first."""
    keys = _keys(switches)
    d = _silence(_units(_ahead(items(prepared, switches, config), keys, switches), config), switches, config)
    known = F.greatest(F.when(F.col("last").isNull(), -1).otherwise(_bar_of(F.col("last"))), F.when(F.size("_rests") > 0, _bar_of(F.col("elapsed"))).otherwise(-1))

    def bar(b: Column) -> Column:
        tokens = F.array(F.lit("Bar_None"))
        if switches.signatures:  # an item that is a TimeSig follows the last Bar itself; those before belong to the section that it ends
            own = F.when(F.col("kind") == "TimeSig", _sign("_p")).otherwise(_sign("_s"))
            tokens = F.when((F.col("kind") == "TimeSig") & (b == F.col("bar")), tokens).otherwise(F.array(F.lit("Bar_None"), own))
        return F.concat(_if(F.lit(switches.bar_ends) & (b > 0), F.lit("Bar_End")), tokens)

    bars = F.when(F.col("bar") > F.col("_known"), F.flatten(F.transform(F.sequence(F.col("_known") + 1, F.greatest(F.col("_known") + 1, F.col("bar"))), bar))).otherwise(_none())
    position = _if(F.col("fresh") & (F.col("kind") != "TimeSig"), _token("Position", F.floor((F.col("time") - F.col("bar_tick")) / F.col("step"))))
    d = d.withColumn("_known", known)
    return _placed(d, keys, ORDER, F.concat("head", "rest_tokens", bars, position, "changed", "tokens"))


def encode_tsd(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id[, track_idx], ord, token): before each item its Rests, and TimeShifts for what they leave. With note_offs this is the grammar of note-ons and
    note-offs, where an item that changes the signature counts as no sound."""
    keys = _keys(switches)
    d = _silence(_units(_ahead(items(prepared, switches, config), keys, switches), config), switches, config, False)
    left = F.floor((F.col("time") - F.coalesce("elapsed", F.lit(0))) / F.col("before_step"))
    shifts = F.transform(greedy(left, [n for n, _ in config.durations]), lambda n: _token("TimeShift", span_name(n, config.durations)))
    return _placed(d, keys, ORDER, F.concat("head", "rest_tokens", shifts, "changed", "tokens"))


def encode_structured(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id[, track_idx], ord, token): TimeShift (the nearest one), [Program], Pitch, Velocity, Duration of each note."""
    keys = _keys(switches)
    d = _ahead(items(prepared, switches, config).where("kind = 'Note'"), keys, switches)
    shift = F.col("time") - F.coalesce("last", F.lit(0))
    near = span_name(nearest_bin(shift, sorted({n for n, _ in config.durations})), config.durations)
    return _placed(d, keys, ORDER, F.concat("head", F.array(_token("TimeShift", F.when(shift == 0, "0.0.1").otherwise(near))), "changed", "tokens"))


def _carried(d: DataFrame, keys: list[str], switches: Switches, config: GridConfig) -> DataFrame:
    """Adds tempo, the token of the last Tempo so far, or of the default one."""
    along = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    tempo = F.last(F.when(F.col("kind") == "Tempo", F.col("tokens")[0]), True).over(along)
    return d.withColumn("tempo", F.coalesce(tempo, F.lit(f"Tempo_{config.default_tempo}")) if switches.tempos else F.lit(None).cast("string"))


def encode_octuple(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id[, track_idx], ord, pitch, position, bar, velocity, duration, program, tempo, signature): a row a note; what a switch leaves out is null."""
    keys = _keys(switches)
    d = _carried(_units(items(prepared, switches, config), config), keys, switches, config).where("kind = 'Note'")
    along = Window.partitionBy(*keys).orderBy(*ORDER)
    note = F.slice("tokens", F.size("tokens") - 2, 3)
    null = F.lit(None).cast("string")
    return d.select(
        *keys, F.row_number().over(along).cast("bigint").alias("ord"), note[0].alias("pitch"), _token("Position", F.floor((F.col("time") - F.col("bar_tick")) / F.col("step"))).alias("position"),
        _token("Bar", F.least(F.col("bar"), F.lit(config.max_bar_embedding - 1))).alias("bar"), note[1].alias("velocity"), note[2].alias("duration"),
        (_token("Program", F.col("program")) if switches.programs else null).alias("program"), "tempo", (_sign("_s") if switches.signatures else null).alias("signature"),
    )


WORD = ["family", "position", "pitch", "velocity", "duration", "program", "chord", "rest", "tempo", "signature"]


def encode_cpword(prepared: Prepared, switches: Switches, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id[, track_idx], ord, *WORD): compound rows. Bars carry the signature, positions the tempo and a chord that begins the onset, notes the program; a
    rest is a row of its own. What a row doesn't have is Ignore_None. Pedals and bends have no place in this grammar."""
    keys = _keys(switches)
    d = _ahead(items(prepared, switches, config), keys, switches)
    d = _carried(_silence(_units(d, config), switches, config), keys, switches, config)
    none = F.lit("Ignore_None")

    def word(**parts: Column) -> Column:
        return F.concat_ws(" ", *[parts.get(c, F.lit("Family_Metric") if c == "family" else none) for c in WORD])

    known = F.greatest(F.when(F.col("last").isNull(), -1).otherwise(_bar_of(F.col("last"))), F.when(F.size("_rests") > 0, _bar_of(F.col("elapsed"))).otherwise(-1))

    def bar(b: Column) -> Column:
        if not switches.signatures:
            return word(position=F.lit("Bar_None"))
        return word(position=F.lit("Bar_None"), signature=F.when((F.col("kind") == "TimeSig") & (b < F.col("bar")), _sign("_p")).otherwise(_sign("_s")))

    bars = F.when(F.col("bar") > F.col("_known"), F.transform(F.sequence(F.col("_known") + 1, F.greatest(F.col("_known") + 1, F.col("bar"))), bar)).otherwise(_none())
    place = _token("Position", F.floor((F.col("time") - F.col("bar_tick")) / F.col("step")))
    chord = F.when(F.col("kind") == "Chord", F.element_at("tokens", -1)).otherwise(none)
    position = _if(F.col("fresh") & (F.col("kind") != "TimeSig"), word(position=place, chord=chord, tempo=F.coalesce("tempo", none)))
    token = F.slice("tokens", F.size("tokens") - 2, 3)
    program = _token("Program", F.col("program")) if switches.programs else none
    note = _if(F.col("kind") == "Note", word(family=F.lit("Family_Note"), pitch=token[0], velocity=token[1], duration=token[2], program=program))
    rests = F.transform("rest_tokens", lambda r: word(rest=r))
    d = _placed(d.withColumn("_known", known), keys, ORDER, F.concat(rests, bars, position, note), "word")
    parts = F.split("word", " ")
    return d.select(*keys, "ord", *[parts[i].alias(c) for i, c in enumerate(WORD)])


def encode_mumidi(prepared: Prepared, config: GridConfig = DEFAULT) -> DataFrame:
    """(score_id, ord, token, bar, position, tempo, velocity, duration): one stream a score in bars of four quarters, every row with the tempo; see
    grammar.encode_mumidi(). prepared: with tempos, without signatures."""
    switches = Switches(tempos=True, programs=True, one_stream=True)
    size, last = 4 * config.tpb, config.max_bar_embedding - 1
    d = _carried(items(prepared, switches, config), ["score_id"], switches, config).where("kind = 'Note'")
    order = ["time", "program", "track_idx", "k1", "k2", "k3"]
    along = Window.partitionBy("score_id").orderBy(*order)
    d = d.withColumn("_last", F.lag("time").over(along)).withColumn("_track", F.lag("program").over(along))
    d = d.withColumn("_bar", F.coalesce(F.floor(F.col("_last") / size), F.lit(-1))).withColumn("_b", F.floor(F.col("time") / size))
    word = lambda *x: F.concat_ws(" ", *x)
    none = F.lit("-")
    bar, position = _token("BarPosEnc", F.least(F.col("_b"), F.lit(last))), _token("PositionPosEnc", F.col("time") % size)
    fresh = ~F.col("_last").eqNullSafe(F.col("time"))
    first = F.col("_bar") + 1
    bars = F.when(F.col("_b") > F.col("_bar"), F.transform(F.sequence(first, F.greatest(first, F.col("_b"))), lambda b: word(F.lit("Bar_None"), _token("BarPosEnc", F.least(b, F.lit(last))), F.lit("PositionPosEnc_None"), F.col("tempo"), none, none))).otherwise(_none())
    onset = _if(fresh, word(_token("Position", F.col("time") % size), bar, position, F.col("tempo"), none, none))
    program = _if(fresh | ~F.col("_track").eqNullSafe(F.col("program")), word(_token("Program", F.col("program")), bar, position, F.col("tempo"), none, none))
    note = F.slice("tokens", F.size("tokens") - 2, 3)
    d = _placed(d, ["score_id"], order, F.concat(bars, onset, program, F.array(word(note[0], bar, position, F.col("tempo"), note[1], note[2]))), "word")
    parts = F.split("word", " ")
    return d.select("score_id", "ord", *[F.when(parts[i] != "-", parts[i]).alias(c) for i, c in enumerate(["token", "bar", "position", "tempo", "velocity", "duration"])])
