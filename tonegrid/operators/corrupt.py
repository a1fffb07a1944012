"""Corruption of id sequences for denoising objectives. Rows: the key columns, pos (from 0) and id; all randomness is a seeded hash of key and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions import uniform


def positions(df: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """(*keys, n, pos, id) of list columns; null and empty lists have no rows."""
    d = df.select(*keys, F.size(ids).alias("n"), F.posexplode(ids).alias("pos", "id"))
    return d.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("pos").cast("bigint").alias("pos"), "id")


def random_parts(sizes: DataFrame, keys: list[str], n: str, k: str, u: Column) -> DataFrame:
    """(*keys, i, part): the numbers 1..n of each row cut into k parts (at most n, at least 1), in order; the k - 1 cuts are those with the least u,
    a random number made of the keys and i."""
    d = sizes.where(F.col(n) > 0).select(*keys, F.greatest(F.lit(1), F.least(F.col(k), F.col(n))).alias("_k"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias("i"))
    by = Window.partitionBy(*keys).orderBy(F.col("i") == 1, F.col("_u"), "i")
    d = d.withColumn("_u", u).withColumn("_rank", F.row_number().over(by))
    d = d.withColumn("_cut", ((F.col("i") > 1) & (F.col("_rank") <= F.col("_k") - 1)).cast("bigint"))
    part = F.sum("_cut").over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + 1
    return d.select(*keys, "i", part.alias("part"))


def noise_mask(sizes: DataFrame, keys: list[str], n: str, density: float, mean_span: float, seed: int = 1) -> DataFrame:
    """(*keys, pos, noise): round(n * density) ids (between 1 and n - 1) in round(noise / mean_span) spans (at least 1) of random lengths; clear and noise spans
    take turns, a clear one first. Rows of fewer than two ids have no noise and no rows."""
    noise = F.greatest(F.lit(1), F.least(F.rint(F.col(n) * density).cast("bigint"), F.col(n) - 1))
    d = sizes.where(F.col(n) > 1).select(*keys, noise.alias("_noise"), (F.col(n) - noise).alias("_clear"))
    d = d.withColumn("_spans", F.greatest(F.lit(1), F.least(F.rint(F.col("_noise") / mean_span).cast("bigint"), F.col("_noise"), F.col("_clear"))))
    sides = F.array(F.struct(F.lit(1).alias("noise"), F.col("_noise").alias("_n")), F.struct(F.lit(0).alias("noise"), F.col("_clear").alias("_n")))
    d = d.select(*keys, "_spans", F.inline(sides))
    u = F.when(F.col("noise") == 1, uniform(seed, *keys, "i")).otherwise(uniform(seed + 1, *keys, "i"))
    rows = random_parts(d, [*keys, "noise"], "_n", "_spans", u)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "noise", "i")) - 1
    return rows.select(*keys, place.cast("bigint").alias("pos"), "noise")


def to_sentinels(d: DataFrame, keys: list[str], first: int, replaced: int = 1, mask: str = "noise") -> DataFrame:
    """(*keys, ord, id): each run of positions whose mask is `replaced` as one sentinel, first + 0, 1, ... in order; other ids stay. ord counts from 1."""
    along = Window.partitionBy(*keys).orderBy("pos")
    inside = F.col(mask) == replaced
    d = d.withColumn("_start", inside & ~F.coalesce(F.lag(inside).over(along), F.lit(False)))
    number = F.sum(F.col("_start").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - 1
    d = d.withColumn("_id", F.when(inside, first + number).otherwise(F.col("id").cast("bigint"))).where(~inside | F.col("_start"))
    return d.select(*keys, F.row_number().over(along).cast("bigint").alias("ord"), F.col("_id").alias("id"))


def span_corruption(df: DataFrame, keys: list[str], ids: str, density: float, mean_span: float, first: int, seed: int = 1) -> DataFrame:
    """(*keys, side, ord, id): encoder side with noise spans as sentinels, decoder side with clear spans as sentinels. Shorter sequences than two ids have no rows."""
    rows = positions(df, keys, ids)
    mask = noise_mask(df.select(*keys, F.size(ids).cast("bigint").alias("n")), keys, "n", density, mean_span, seed)
    d = rows.join(mask, [*keys, "pos"])
    return to_sentinels(d, keys, first, 1).withColumn("side", F.lit("encoder")).unionByName(to_sentinels(d, keys, first, 0).withColumn("side", F.lit("decoder")))


def structure_marks(rows: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """(*keys, pos, mark): positions of bars, beats (Position_0), notes and times."""
    kind = F.substring_index(token, "_", 1)
    marks = F.array_compact(F.array(F.when(kind == "Bar", "bar"), F.when(F.col(token) == "Position_0", "beat"), F.when(kind.isin("Pitch", "PitchDrum"), "note"), F.when(kind.isin("Position", "TimeShift"), "time")))
    return rows.select(*keys, "pos", F.explode(marks).alias("mark"))


def align_spans(d: DataFrame, keys: list[str], boundary: Column) -> DataFrame:
    """(*keys, pos, noise): each noise span moved, with its length, to the first boundary at or after its start (else the last one); spans end with the sequence.
    d: (*keys, pos, noise, ...). A sequence without boundaries stays as it is. Two windows carry the next and the last boundary to every row."""
    along = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    d = d.withColumn("_b", F.when(boundary, F.col("pos")))
    d = d.withColumn("_next", F.first("_b", True).over(along.rowsBetween(0, Window.unboundedFollowing))).withColumn("_final", F.max("_b").over(whole)).withColumn("_n", F.count("*").over(whole))
    inside = F.col("noise") == 1
    d = d.withColumn("_start", inside & ~F.coalesce(F.lag(inside).over(along), F.lit(False)))
    d = d.withColumn("_span", F.sum(F.col("_start").cast("bigint")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.coalesce(F.col("_next"), F.col("_final"), F.col("pos"))
    spans = d.where(inside).groupBy(*keys, "_span").agg(F.min_by(at, "pos").alias("_at"), F.count("*").alias("_k"), F.max("_n").alias("_n"))
    moved = spans.select(*keys, F.explode(F.sequence("_at", F.least(F.col("_at") + F.col("_k"), F.col("_n")) - 1)).alias("pos")).distinct().withColumn("_moved", F.lit(1))
    return d.select(*keys, "pos").join(moved, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("_moved", F.lit(0)).alias("noise"))


#: Density, mean length of spans and the boundaries they are aligned to, of each denoising task.
TASKS = {"beat": (0.15, 2.0, "beat"), "measure": (0.30, 2.0, "bar"), "note": (0.15, 3.0, "note"), "heavy": (0.50, 8.0, None)}


def denoise(df: DataFrame, keys: list[str], ids: str, task: str, boundary_ids: dict[str, list[int]], seed: int = 1) -> DataFrame:
    """(*keys, pos, id, noise) of a denoising task; boundary_ids: the ids that begin a bar, a beat or a note."""
    density, span, mark = TASKS[task]
    rows = positions(df, keys, ids)
    mask = noise_mask(df.select(*keys, F.size(ids).cast("bigint").alias("n")), keys, "n", density, span, seed)
    d = rows.join(mask, [*keys, "pos"])
    if mark:
        d = rows.join(align_spans(d, keys, F.col("id").isin(boundary_ids[mark])), [*keys, "pos"])
    return d.select(*keys, "pos", "id", "noise")


def attribute_denoise(rows: DataFrame, keys: list[str], types: dict[str, tuple[int, int]], share: float = 0.2, seed: int = 1) -> DataFrame:
    """(*keys, pos, id): round(share * n) of the ids of the given types are replaced by a random id of their type. types: first and last id of each."""
    low = high = F.lit(None).cast("int")
    for a, b in types.values():
        low, high = F.when(F.col("id").between(a, b), a).otherwise(low), F.when(F.col("id").between(a, b), b).otherwise(high)
    d = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_own", F.col("_low").isNotNull())
    by = Window.partitionBy(*keys, "_own")
    d = d.withColumn("_r", F.row_number().over(by.orderBy(uniform(seed, *keys, "pos"), "pos"))).withColumn("_n", F.count("*").over(by))
    new = F.col("_low") + F.floor(uniform(seed + 1, *keys, "pos") * (F.col("_high") - F.col("_low") + 1))
    return d.select(*keys, "pos", F.when(F.col("_own") & (F.col("_r") <= F.rint(F.col("_n") * share)), new).otherwise(F.col("id")).cast("int").alias("id"))


def continuation(rows: DataFrame, keys: list[str], boundary: Column, low: float = 0.2, high: float = 0.5, seed: int = 1) -> DataFrame:
    """(*keys, pos, id, side): the sequence cut at a random boundary within [low * n, high * n), at low * n where there is none: 0 is given, 1 to be continued."""
    eligible = boundary & (F.col("pos") >= F.floor(F.col("n") * low)) & (F.col("pos") < F.floor(F.col("n") * high)) & (F.col("pos") > 0)
    cut = F.min_by("pos", F.when(eligible, F.struct(uniform(seed, *keys, "pos").alias("u"), F.col("pos").alias("p")))).over(Window.partitionBy(*keys))
    return rows.select(*keys, "pos", "id", (F.col("pos") >= F.coalesce(cut, F.floor(F.col("n") * low))).cast("int").alias("side"))


def with_bars(rows: DataFrame, keys: list[str], bar_id: int) -> DataFrame:
    """Adds bar: 0 before the first bar id, then 1, 2, ...; a bar id begins its bar."""
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bar", F.sum((F.col("id") == bar_id).cast("bigint")).over(upto))


def drop_bars(rows: DataFrame, keys: list[str], share: float, seed: int = 1) -> DataFrame:
    """Rows (with bar) without the bars whose hash is below share; what stands before the first bar stays."""
    return rows.where((F.col("bar") == 0) | (uniform(seed, *keys, "bar") >= share))


def permute_bars(rows: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """(*keys, ord, id): bars in the order of their hash, what stands before the first bar first."""
    place = Window.partitionBy(*keys).orderBy(F.col("bar") > 0, F.when(F.col("bar") > 0, uniform(seed, *keys, "bar")), "bar", "pos")
    return rows.select(*keys, F.row_number().over(place).cast("bigint").alias("ord"), "id")


def delete_tokens(rows: DataFrame, keys: list[str], share: float, seed: int = 1) -> DataFrame:
    """Rows without those whose hash is below share."""
    return rows.where(uniform(seed, *keys, "pos") >= share)


def bert_mask(rows: DataFrame, keys: list[str], mask_id: int, n_ids: int, share: float = 0.15, seed: int = 1) -> DataFrame:
    """(*keys, pos, id, label): of the chosen ids 80 % become mask_id, 10 % a random id, 10 % stay; label is the id that was chosen, else -100."""
    chosen, u = uniform(seed, *keys, "pos") < share, uniform(seed + 1, *keys, "pos")
    new = F.when(u < 0.8, mask_id).when(u < 0.9, F.floor(uniform(seed + 2, *keys, "pos") * n_ids)).otherwise(F.col("id"))
    return rows.select(*keys, "pos", F.when(chosen, new).otherwise(F.col("id")).cast("int").alias("id"), F.when(chosen, F.col("id")).otherwise(-100).cast("int").alias("label"))


def drop_tracks(rows: DataFrame, score: str, track: str, share: float, seed: int = 1) -> DataFrame:
    """Rows without the tracks whose hash is below share; a score's track with the largest hash always stays."""
    u = uniform(seed, score, track)
    best = F.max(u).over(Window.partitionBy(score))
    return rows.withColumn("_u", u).withColumn("_best", best).where((F.col("_u") >= share) | (F.col("_u") == F.col("_best"))).drop("_u", "_best")


def merge_by_bar(rows: DataFrame, score: str, track: str, bar_id: int) -> DataFrame:
    """(score, ord, id): the tracks of a score interleaved bar by bar, one bar id each, then the tracks' ids in order. rows have bar (from with_bars)."""
    d = rows.where(F.col("id") != bar_id).select(score, "bar", F.lit(1).alias("_k"), track, "pos", "id")
    heads = rows.where(F.col("id") == bar_id).select(score, "bar").distinct().select(score, "bar", F.lit(0).alias("_k"), F.lit(None).cast("int").alias(track), F.lit(None).cast("bigint").alias("pos"), F.lit(bar_id).alias("id"))
    place = Window.partitionBy(score).orderBy("bar", "_k", track, "pos")
    return d.unionByName(heads).repartition(score).select(score, F.row_number().over(place).cast("bigint").alias("ord"), "id")


def with_beats(rows: DataFrame, keys: list[str], first: int, last: int, per: int) -> DataFrame:
    """Rows with bar get beat: 10 * bar + the beat in the bar (from 1, of the latest position id first..last; 0 before any), `per` positions a beat."""
    upto = Window.partitionBy(*keys, "bar").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    beat = F.max(F.when(F.col("id").between(first, last), F.floor((F.col("id") - first) / per) + 1)).over(upto)
    return rows.withColumn("beat", F.col("bar") * 10 + F.coalesce(beat, F.lit(0)))


def drop_units(rows: DataFrame, keys: list[str], unit: str, share: float, seed: int = 1) -> DataFrame:
    """Rows without the units (bars, beats) whose hash is below share; unit 0 stays."""
    return rows.where((F.col(unit) == 0) | (uniform(seed, *keys, unit) >= share))


def permute_within(rows: DataFrame, keys: list[str], outer: str, unit: str, base: int, seed: int = 1) -> DataFrame:
    """(*keys, ord, id): units in the order of their hash inside their outer unit; a unit that is a multiple of base (what stands before) is first."""
    place = Window.partitionBy(*keys).orderBy(outer, F.when(F.col(unit) % base > 0, uniform(seed, *keys, unit)).otherwise(-1), unit, "pos")
    return rows.select(*keys, F.row_number().over(place).cast("bigint").alias("ord"), "id")


def drop_aligned(rows: DataFrame, score: str, unit: str, share: float, seed: int = 1) -> DataFrame:
    """Rows without the units whose hash of score and unit is below share: the same bars of all tracks."""
    return rows.where((F.col(unit) == 0) | (uniform(seed, score, unit) >= share))


def drop_notes(rows: DataFrame, keys: list[str], starts: tuple[int, int], own: tuple[int, int], share: float, seed: int = 1) -> DataFrame:
    """Rows without the notes (an id within `starts` and those within `own` up to the next start) whose hash is below share; adds note, their number."""
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("note", F.sum(F.col("id").between(*starts).cast("bigint")).over(upto))
    return d.where((F.col("note") == 0) | ~F.col("id").between(*own) | (uniform(seed, *keys, "note") >= share))
