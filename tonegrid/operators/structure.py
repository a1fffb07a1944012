"""Operators on whole scores and tracks: merging, joining, cutting, moving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.operators.preprocess import TRACK

REST = ["duration", "pitch", "velocity"]


def merge_tracks(notes: DataFrame) -> DataFrame:
    """score_id, ord, track_idx, time, duration, pitch, velocity: all notes of a score as one track, by time, then track."""
    along = Window.partitionBy("score_id").orderBy("time", "track_idx", *REST)
    return notes.select("score_id", F.row_number().over(along).cast("bigint").alias("ord"), "track_idx", "time", *REST)


def merged_names(tracks: DataFrame) -> DataFrame:
    """score_id, name: the names of a score's tracks in order, joined by ' / '; null names are left out."""
    d = tracks.groupBy("score_id").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("track_idx", "name")))).alias("t"))
    return d.select("score_id", F.concat_ws(" / ", F.col("t.name")).alias("name"))


def merge_same_program(notes: DataFrame) -> DataFrame:
    """Notes whose track_idx is that of the first track of their program in the score."""
    firsts = notes.groupBy("score_id", "program").agg(F.min("track_idx").alias("first"))
    return notes.join(firsts, ["score_id", "program"]).withColumn("track_idx", F.col("first")).drop("first")


def program_class(program: Column) -> Column:
    """The instrument class of a program: eight programs each, 16 for drums (-1)."""
    return F.when(program < 0, 16).otherwise(F.floor(program / 8)).cast("int")


def merge_per_class(notes: DataFrame, most: int | None = None, pitches: tuple[int, int] = (0, 127)) -> DataFrame:
    """Notes with class and the program of the class (its first), of the `most` lowest classes of a score, pitches within the range given."""
    d = notes.where(F.col("pitch").between(*pitches)).withColumn("class", program_class(F.col("program")))
    if most:
        rank = Window.partitionBy("score_id").orderBy("class")
        d = d.withColumn("_n", F.dense_rank().over(rank)).where(F.col("_n") <= most).drop("_n")
    return d.withColumn("program", F.when(F.col("class") == 16, -1).otherwise(F.col("class") * 8))


def score_ends(notes: DataFrame) -> DataFrame:
    """score_id, end: the last tick of a score's notes."""
    return notes.groupBy("score_id").agg(F.max(F.col("time") + F.col("duration")).alias("end"))


def concat_scores(notes: DataFrame, parts: DataFrame) -> DataFrame:
    """new_id, track_idx, time, ...: scores one after the other, each shifted by the ends of those before. parts: (score_id, new_id, pos)."""
    along = Window.partitionBy("new_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.join(score_ends(notes), "score_id").withColumn("shift", F.coalesce(F.sum("end").over(along), F.lit(0))).select("score_id", "new_id", "shift")
    return notes.join(shifts, "score_id").withColumn("time", F.col("time") + F.col("shift")).drop("shift")


def merge_scores(notes: DataFrame, parts: DataFrame, tpq: DataFrame) -> DataFrame:
    """Scores laid over one another: new_id, track_idx (numbered anew), time, ...; only groups whose scores have one resolution."""
    same = parts.join(tpq, "score_id").groupBy("new_id").agg(F.count_distinct("tpq").alias("n")).where("n = 1").select("new_id")
    own = notes.select(*TRACK).distinct().join(parts.join(same, "new_id"), "score_id")
    along = Window.partitionBy("new_id").orderBy("pos", "track_idx")
    own = own.select("score_id", "track_idx", "new_id", (F.row_number().over(along) - 1).cast("int").alias("new_track"))
    return notes.join(own, TRACK).drop("score_id", "track_idx").withColumnRenamed("new_track", "track_idx")


def clip(notes: DataFrame, start: int, end: int) -> DataFrame:
    """Notes that start in [start, end), rebased to 0; their ends aren't cut."""
    return notes.where(F.col("time").between(start, end - 1)).withColumn("time", F.col("time") - start)


def shift_time(notes: DataFrame, offset: int) -> DataFrame:
    """Notes moved by offset, none before 0."""
    return notes.withColumn("time", F.greatest(F.lit(0), F.col("time") + offset))


def split_at(notes: DataFrame, size: int, least: int = 0) -> DataFrame:
    """Notes with piece (from 0), rebased: pieces of `size` positions; a last piece whose notes span less than `least` is dropped."""
    d = notes.withColumn("piece", F.floor(F.col("time") / size)).withColumn("time", F.col("time") % size)
    if least:
        ends = notes.groupBy("score_id").agg(F.max("time").alias("t")).withColumn("last", F.floor(F.col("t") / size)).where((F.col("t") % size) + 1 < least).select("score_id", F.col("last").alias("piece"))
        d = d.join(ends, ["score_id", "piece"], "left_anti")
    return d


def split_by_density(counts: DataFrame, most: int, overlap: int = 1, least: int | None = None) -> DataFrame:
    """score_id, piece, first_bar, last_bar: consecutive bars that have at most `most` tokens together, neighbours sharing `overlap` bars.

    counts: (score_id, bar, n) of all bars of a score. A bar above `most` is a piece by itself; a last piece below `least` (a quarter of most) is dropped.
    A fold along the bars of a score, in the JVM; a score has few bars.
    """
    least = most // 4 if least is None else least
    bars = counts.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("bar", "n"))).alias("b"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>")
    start = F.struct(empty.alias("out"), F.array().cast("array<struct<bar:bigint,n:bigint>>").alias("cur"))
    total = lambda cur: F.aggregate(cur, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    piece = lambda cur: F.array(F.struct(F.element_at(cur, 1)["bar"].alias("first"), F.element_at(cur, -1)["bar"].alias("last"), total(cur).alias("n")))

    def step(acc, x):
        cur, x = acc["cur"], F.struct(x["bar"].cast("bigint").alias("bar"), x["n"].cast("bigint").alias("n"))
        full = (F.size(cur) > 0) & (total(cur) + x["n"] > most)
        kept = F.slice(cur, F.greatest(F.lit(1), F.size(cur) - overlap + 1), overlap) if overlap else F.slice(cur, 1, 0)
        kept = F.when((total(kept) + x["n"] <= most) & (F.size(kept) < F.size(cur)), kept).otherwise(F.slice(cur, 1, 0))
        return F.struct(F.when(full, F.concat(acc["out"], piece(cur))).otherwise(acc["out"]).alias("out"), F.when(full, F.concat(kept, F.array(x))).otherwise(F.concat(cur, F.array(x))).alias("cur"))

    done = F.aggregate("b", start, step, lambda acc: F.concat(acc["out"], F.when(total(acc["cur"]) >= least, piece(acc["cur"])).otherwise(empty)))
    d = bars.select("score_id", F.posexplode(done).alias("piece", "p"))
    return d.select("score_id", F.col("piece").cast("bigint").alias("piece"), F.col("p.first").alias("first_bar"), F.col("p.last").alias("last_bar"))


def subsequences(df: DataFrame, keys: list[str], n: str, size: int, least: int) -> DataFrame:
    """(*keys, piece, first_pos, last_pos): pieces of `size` ids from the start on, as long as at least `least` + 1 ids are left."""
    d = df.where(F.col(n) > least)
    d = d.select(*keys, n, F.posexplode(F.sequence(F.lit(0), F.col(n) - least - 1, F.lit(size))).alias("piece", "first_pos"))
    return d.select(*keys, F.col("piece").cast("bigint").alias("piece"), F.col("first_pos").cast("bigint").alias("first_pos"), (F.least(F.col("first_pos") + size, F.col(n)) - 1).cast("bigint").alias("last_pos"))


# segments of bars


def fixed_segments(bars: DataFrame, size: int, least: int = 1) -> DataFrame:
    """score_id, start_bar, end_bar: every `size` bars; a last one of fewer than `least` bars is dropped. bars: (score_id, n_bars)."""
    d = bars.where("n_bars > 0").select("score_id", "n_bars", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bars") - 1, F.lit(size).cast("bigint"))).alias("start_bar"))
    d = d.select("score_id", "start_bar", F.least(F.col("start_bar") + size, F.col("n_bars")).alias("end_bar"))
    return d.where(F.col("end_bar") - F.col("start_bar") >= least)


def sliding_segments(bars: DataFrame, size: int, stride: int) -> DataFrame:
    """score_id, start_bar, end_bar: whole windows every `stride` bars that aren't fixed segments; only of scores longer than a window."""
    d = bars.where(F.col("n_bars") > size).select("score_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bars") - size, F.lit(stride).cast("bigint"))).alias("start_bar"))
    return d.where(F.col("start_bar") % size != 0).select("score_id", "start_bar", (F.col("start_bar") + size).alias("end_bar"))


def variable_segments(bars: DataFrame, size: int, least: int, seed: int = 1) -> DataFrame:
    """score_id, start_bar, end_bar: max(1, n_bars div size) segments of a seeded random length and start."""
    from tonegrid.functions import uniform

    d = bars.where(F.col("n_bars") >= least).select("score_id", "n_bars", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1), F.floor(F.col("n_bars") / size)))).alias("i"))
    length = F.lit(least) + F.floor(uniform(seed, "score_id", "i") * (F.least(F.lit(size), F.col("n_bars")) - least + 1))
    d = d.withColumn("length", length)
    return d.select("score_id", F.floor(uniform(seed + 1, "score_id", "i") * (F.col("n_bars") - F.col("length") + 1)).alias("start_bar"), "length").select("score_id", "start_bar", (F.col("start_bar") + F.col("length")).alias("end_bar"))


def cut_segments(notes: DataFrame, segments: DataFrame, bar: int) -> DataFrame:
    """The notes of each segment, rebased to its start: an equi-join on (score_id, bar) over the bars of each segment; empty segments vanish."""
    s = segments.withColumn("bar", F.explode(F.sequence("start_bar", F.col("end_bar") - 1)))
    d = notes.withColumn("bar", F.floor(F.col("time") / bar)).join(s, ["score_id", "bar"])
    return d.withColumn("time", F.col("time") - F.col("start_bar") * bar).drop("bar")


# augmentation


def offset_tuples(pitch: list[int], velocity: list[int], duration: list[float], all_combinations: bool = False) -> list[tuple[int, int, float]]:
    """Offsets (pitch, velocity, beats of duration) to apply: one at a time, or all combinations; without the one that changes nothing."""
    if not all_combinations:
        return [(p, 0, 0.0) for p in pitch if p] + [(0, v, 0.0) for v in velocity if v] + [(0, 0, d) for d in duration if d]
    return [(p, v, d) for p in sorted({0, *pitch}) for v in sorted({0, *velocity}) for d in sorted({0.0, *duration}) if (p, v, d) != (0, 0, 0.0)]


def augment(notes: DataFrame, offsets: list[tuple[int, int, float]], tpb: int, velocities: tuple[int, int] = (1, 127), min_beats: float = 0.03125) -> DataFrame:
    """Notes once for each offset, with `variant` (#p<pitch>_v<velocity>_d<duration>): pitch and duration of drums stay, velocities are clamped, durations that shrink
    last min_beats at least. A score gets no pitch offset that would take a melodic note out of 0..127. The list of offsets is a parameter."""
    span = notes.where("not is_drum").groupBy("score_id").agg(F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v"), F.lit(int(d * tpb)).alias("d"), F.lit(f"#p{p}_v{v}_d{d:g}").alias("variant")) for p, v, d in offsets])
    d = notes.join(span, "score_id", "left").withColumn("o", F.explode(table))
    d = d.where((F.col("o.p") == 0) | (F.coalesce(F.col("low") + F.col("o.p"), F.lit(0)) >= 0) & (F.coalesce(F.col("high") + F.col("o.p"), F.lit(0)) <= 127))
    least = F.lit(max(1, int(min_beats * tpb)))
    long = F.when(F.col("is_drum") | (F.col("o.d") == 0), F.col("duration")).when(F.col("o.d") > 0, F.col("duration") + F.col("o.d")).otherwise(F.greatest(least, F.col("duration") + F.col("o.d")))
    pitch = F.when(F.col("is_drum"), F.col("pitch")).otherwise(F.col("pitch") + F.col("o.p"))
    loud = F.when(F.col("o.v") == 0, F.col("velocity")).otherwise(F.greatest(F.lit(velocities[0]), F.least(F.lit(velocities[1]), F.col("velocity") + F.col("o.v"))))
    return d.select(*TRACK, F.col("o.variant").alias("variant"), "time", long.cast("bigint").alias("duration"), pitch.cast("int").alias("pitch"), loud.cast("bigint").alias("velocity"))
