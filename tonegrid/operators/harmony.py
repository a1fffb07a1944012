"""What lies between notes: chords, intervals, program changes, rests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.functions import greedy, span_name
from tonegrid.operators.grammar import _note_tokens, _placed, _token
from tonegrid.operators.preprocess import NOTE_ORDER, TRACK

#: Chord qualities by their intervals from the lowest note.
CHORDS = {
    "min": (0, 3, 7),
    "maj": (0, 4, 7),
    "dim": (0, 3, 6),
    "aug": (0, 4, 8),
    "sus2": (0, 2, 7),
    "sus4": (0, 5, 7),
    "7dom": (0, 4, 7, 10),
    "7min": (0, 3, 7, 10),
    "7maj": (0, 4, 7, 11),
    "7halfdim": (0, 3, 6, 10),
    "7dim": (0, 3, 6, 9),
    "7aug": (0, 4, 8, 11),
    "9maj": (0, 4, 7, 10, 14),
    "9min": (0, 4, 7, 10, 13),
}
#: Names of pitch classes.
CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def chords(notes: DataFrame, tpb: int, unknown: bool = False, root: bool = True, most: int = 10) -> DataFrame:
    """score_id, track_idx, time, chord: the chord of each onset, from its `most` lowest notes. An onset whose notes end more than half a beat
    apart has none; a chord has 3 to 5 notes within two octaves, and a known quality unless `unknown` (then ukn<n>)."""
    half = tpb // 2
    d = notes.groupBy(*TRACK, "time").agg(F.slice(F.array_sort(F.collect_list(F.struct("pitch", (F.col("time") + F.col("duration")).alias("end")))), 1, most).alias("n"))
    first = F.col("n")[0]
    d = d.where(F.size("n").between(3, 5) & ~F.exists("n", lambda x: F.abs(x["end"] - first["end"]) > half))
    steps = F.array_join(F.transform("n", lambda x: x["pitch"] - first["pitch"]).cast("array<string>"), ",")
    table = F.create_map(*[F.lit(x) for name, s in CHORDS.items() for x in (",".join(map(str, s)), name)])
    name = F.coalesce(table[steps], F.concat(F.lit("ukn"), F.size("n").cast("string"))) if unknown else table[steps]
    names = F.array(*[F.lit(c) for c in CLASSES])
    chord = F.concat(names[(first["pitch"] % 12).cast("int")], F.lit(":"), name) if root else name
    return d.where(F.element_at("n", -1)["pitch"] - first["pitch"] <= 24).select(*TRACK, "time", chord.alias("chord")).where("chord is not null")


def chords_within(notes: DataFrame, tpb: int, offset: float = 0.25, most: int = 10, unknown: bool = False) -> DataFrame:
    """score_id, track_idx, time, chord, as chords(), but onsets up to `offset` beats apart sound together: a scan along each track that takes the next notes
    within the offset, and goes on after them whether they were a chord or not. What is taken depends on what was taken before, so a track is
    scanned in order, in Python, as one array."""
    half, near = tpb // 2, tpb * offset
    known = {v: k for k, v in CHORDS.items()}

    def scan(own: list) -> Iterator[tuple[int, str]]:
        """own: (time, pitch, end) of a track's notes in order. `spent` is the latest onset of the notes taken last; a group whose ends differ is passed over, and spends none."""
        at, spent = 0, None
        while at < len(own):
            start, pitch, end = own[at]
            if start == spent:
                at += 1
                continue
            taken = [x for x in own[at : at + most] if x[0] - start <= near]
            if max(abs(e - end) for _, _, e in taken) <= half:
                if end - start <= half:  # short notes only go with those of their own onset
                    taken = [x for x in taken if x[0] == start]
                steps = tuple(p - pitch for _, p, _ in taken)
                if 3 <= len(steps) <= 5 and steps[-1] <= 24 and (unknown or steps in known):
                    yield start, f"{CLASSES[pitch % 12]}:{known.get(steps, f'ukn{len(steps)}')}"
                spent = taken[-1][0]
            at += len(taken)

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(s, t, *x) for s, t, own in zip(pdf.score_id, pdf.track_idx, pdf.notes) for x in scan([(n["time"], n["pitch"], n["end"]) for n in own])]
            yield pd.DataFrame(out, columns=[*TRACK, "time", "chord"])

    d = notes.groupBy(*TRACK).agg(F.array_sort(F.collect_list(F.struct("time", "pitch", (F.col("time") + F.col("duration")).alias("end")))).alias("notes"))
    return d.mapInPandas(rows, "score_id bigint, track_idx int, time bigint, chord string")


def pitch_intervals(notes: DataFrame, reach: int, most: int = 16) -> DataFrame:
    """score_id, track_idx, ord, token: each note's PitchIntervalTime (to the pitch of the onset before, at most `reach` earlier), PitchIntervalChord (to the note
    before at the same onset) or Pitch, where the interval is above `most`. Drums are left out.

    The pitch that the next onset refers to is the last one that began an onset or stood alone: one window carries it along, no fold is needed.
    """
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    d = notes.where("not is_drum").withColumn("_t", F.lag("time").over(along)).withColumn("_p", F.lag("pitch").over(along))
    fresh = ~F.col("_t").eqNullSafe(F.col("time"))
    d = d.withColumn("_set", F.when(fresh | (F.abs(F.col("pitch") - F.col("_p")) > most), F.col("pitch")))
    d = d.withColumn("_o", F.last("_set", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    step, jump = F.col("pitch") - F.col("_p"), F.col("pitch") - F.col("_o")
    token = F.when(fresh & (F.col("time") - F.col("_t") <= reach) & (F.abs(jump) <= most), _token("PitchIntervalTime", jump))
    token = token.when(~fresh & (F.abs(step) <= most), _token("PitchIntervalChord", step)).otherwise(_token("Pitch", F.col("pitch")))
    return d.select(*TRACK, F.row_number().over(along).cast("bigint").alias("ord"), token.alias("token"))


def program_changes(notes: DataFrame) -> DataFrame:
    """score_id, ord, time, program: where, in a score's notes by time and track, the program differs from that of the note before."""
    along = Window.partitionBy("score_id").orderBy("time", "track_idx", "duration", "pitch", "velocity")
    d = notes.select("score_id", F.row_number().over(along).cast("bigint").alias("ord"), "time", "program", F.lag("program").over(along).alias("_p"))
    return d.where(~F.col("_p").eqNullSafe(F.col("program"))).drop("_p")


def encode_tsd_rests(notes: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """score_id, track_idx, ord, token: encode_tsd() with Rest tokens for silences: from the latest note end so far to a new onset, if at least the shortest rest."""
    along = Window.partitionBy(*TRACK).orderBy(*NOTE_ORDER)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    d = notes.withColumn("_last", F.coalesce(F.lag("time").over(along), F.lit(0)))
    d = d.withColumn("_end", F.coalesce(F.max(F.col("time") + F.col("duration")).over(before), F.lit(0)))
    rest = (F.col("time") != F.col("_last")) & (F.col("time") - F.col("_end") >= min(n for n, _ in config.rests))
    rests = F.transform(greedy(F.col("time") - F.col("_end"), [n for n, _ in config.rests]), lambda n: _token("Rest", span_name(n, config.rests)))
    shifts = F.transform(greedy(F.col("time") - F.col("_last"), [n for n, _ in config.durations]), lambda n: _token("TimeShift", span_name(n, config.durations)))
    return _placed(d, TRACK, NOTE_ORDER, F.concat(F.when(rest, rests).otherwise(shifts), F.array(*_note_tokens(config))))


def decode_tsd_rests(tokens: DataFrame, config: GridConfig = DEFAULT) -> DataFrame:
    """Notes of encode_tsd_rests() tokens. A rest begins at the latest note end so far, which depends on the rests before it; but after a rest all earlier
    notes are over, so rests cut a track into stretches whose length is known from themselves, and their starts are running sums. No fold is needed."""
    from tonegrid.operators.grammar import _kind, _length, _value

    along = Window.partitionBy(*TRACK).orderBy("ord")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    rest = _kind() == "Rest"
    d = tokens.withColumn("_cut", (rest & ~F.coalesce(F.lag(rest).over(along), F.lit(False))).cast("bigint")).withColumn("_part", F.sum("_cut").over(upto))
    d = d.withColumn("_rest", F.when(rest, _length(_value(), config)).otherwise(0))
    in_part = Window.partitionBy(*TRACK, "_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_at", F.sum(F.when(_kind() == "TimeShift", _length(_value(), config)).otherwise(0)).over(in_part))
    for i, kind in ((1, "Velocity"), (2, "Duration")):
        ahead = F.lead("token", i).over(along)
        d = d.withColumn(f"_{kind}", F.when(F.substring_index(ahead, "_", 1) == kind, F.substring_index(ahead, "_", -1)))
    note = _kind().isin("Pitch", "PitchDrum") & F.col("_Velocity").isNotNull() & F.col("_Duration").isNotNull()
    d = d.withColumn("_long", F.when(note, _length(F.col("_Duration"), config)))
    parts = d.groupBy(*TRACK, "_part").agg(F.sum("_rest").alias("_rest"), F.coalesce(F.max(F.col("_at") + F.col("_long")), F.lit(0)).alias("_end"))
    order = Window.partitionBy(*TRACK).orderBy("_part")
    start = F.sum("_rest").over(order) + F.coalesce(F.sum("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*TRACK, "_part", start.alias("_start"))
    d = d.where(note).join(parts, [*TRACK, "_part"])
    return d.select(*TRACK, (_kind() == "PitchDrum").alias("is_drum"), (F.col("_start") + F.col("_at")).alias("time"), F.col("_long").alias("duration"), _value().cast("int").alias("pitch"), F.col("_Velocity").cast("bigint").alias("velocity"))
