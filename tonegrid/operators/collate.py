"""Batches, padding, prompts, vocabularies of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.functions import uniform


def bos_eos(ids: Column, most: int, bos: int | None, eos: int | None) -> Column:
    """ids cut to the length left beside BOS and EOS; a list that had to be cut gets no EOS. Id 0 counts as an id."""
    room = most - (bos is not None) - (eos is not None)
    cut = F.slice(ids, 1, room)
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [cut] + ([F.when(F.size(ids) <= room, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))] if eos is not None else [])
    return F.concat(*parts)


def padded(ids: Column, size: Column | int, pad: int, left: bool = False) -> Column:
    """ids filled up with pad to `size`, cut to it if longer."""
    size = F.lit(size) if isinstance(size, int) else size
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), size - F.size(ids)))
    return F.slice(F.concat(fill, ids) if left else F.concat(ids, fill), 1, size)


def collate(df: DataFrame, batch: list[str], ids: str, pad: int, label_pad: int = -100, left: bool = False, shift: bool = False, multiple: int = 1) -> DataFrame:
    """input_ids, attention_mask and labels of each row, padded to the longest of its batch; empty and null rows are skipped. The longest comes
    from an aggregate of lengths, not from gathered batches. shift: labels are those of the next place. multiple: lengths are rounded up to a multiple of it."""
    d = df.where(F.size(ids) > 0)
    d = d.withColumn("_size", (F.ceil(F.max(F.size(ids)).over(Window.partitionBy(*batch)) / multiple) * multiple).cast("int"))
    labels = F.slice(ids, 2, F.size(ids)) if shift else F.col(ids)
    mask = padded(F.transform(F.col(ids), lambda _: F.lit(1)), F.col("_size"), 0, left)
    return d.withColumn("input_ids", padded(F.col(ids), F.col("_size"), pad, left)).withColumn("attention_mask", mask).withColumn("labels", padded(labels, F.col("_size"), label_pad, left)).drop("_size")


def merge_vocabularies(text: DataFrame, music: DataFrame) -> DataFrame:
    """token, id: the text vocabulary as it is, then the tokens only `music` has, sorted, from the largest id + 1 on. Vocabularies are small tables."""
    top = text.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("top"))
    new = music.select("token").distinct().join(text.select("token"), "token", "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.orderBy("token")) - 1).withColumn("top", top.scalar())
    return text.select("token", F.col("id").cast("bigint").alias("id")).unionByName(new.select("token", (F.col("top") + F.col("_n")).cast("bigint").alias("id")))


def sentinels(vocab: DataFrame, template: str = "<extra_id_{}>") -> DataFrame:
    """token, id of the sentinels numbered 0, 1, ... without a gap."""
    before, after = template.split("{}")
    inner = F.substring("token", len(before) + 1, F.length("token") - len(before) - len(after))
    d = vocab.where(F.col("token").startswith(before) & F.col("token").endswith(after)).withColumn("i", inner.cast("bigint")).where("i is not null")
    return d.withColumn("_n", F.row_number().over(Window.orderBy("i")) - 1).where("i = _n").select("token", "id")


#: Prompts of each task, in our own words; {} are the numbers of bars and beats.
PROMPTS = {
    "beat": ["Restore the missing beats of {} bars.", "Fill in the gaps of {} bars, {} beats."],
    "measure": ["Restore the missing bars among {}.", "Write the left out bars of a piece of {} bars, {} beats."],
    "note": ["Restore the missing notes of {} bars."],
    "heavy": ["Rebuild {} bars, {} beats, from what is left."],
    "attribute": ["Correct the pitches, velocities and durations of {} bars."],
    "continuation": ["Go on after {} bars.", "Continue the piece of {} bars, {} beats."],
}


def prompts(d: DataFrame, keys: list[str], seed: int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds task and prompt: a task drawn by weight and one of its prompts, both by a seeded hash of the keys. d has n_bars and n_beats."""
    weights = weights or {t: 1.0 for t in PROMPTS}
    total, below, u = sum(weights.values()), 0.0, uniform(seed, *keys)
    task = F.lit(list(weights)[-1])
    cuts = []
    for name, w in list(weights.items())[:-1]:
        below += w / total
        cuts.append((below, name))
    for cut, name in reversed(cuts):
        task = F.when(u < cut, name).otherwise(task)
    d = d.withColumn("task", task)
    pick, text = uniform(seed + 1, *keys), F.lit(None).cast("string")
    filled = lambda option: F.format_string(option.replace("{}", "%d"), "n_bars", "n_beats")
    for name, options in PROMPTS.items():
        chosen = filled(options[-1])
        for i, option in reversed(list(enumerate(options[:-1], 1))):
            chosen = F.when(pick < i / len(options), filled(option)).otherwise(chosen)
        text = F.when(F.col("task") == name, chosen).otherwise(text)
    return d.withColumn("prompt", text)


def chunks(d: DataFrame, keys: list[str], ids: str, size: int, least: int, bos: int, eos: int) -> DataFrame:
    """(*keys, piece, ids): lists cut into pieces of `size` (a rest of at most `least` ids is dropped), BOS before the first piece and EOS after the last one only."""
    from tonegrid.operators.structure import subsequences

    n = d.withColumn("_n", F.size(ids))
    cut = subsequences(n.select(*keys, ids, "_n"), [*keys, ids, "_n"], "_n", size, least)
    last = F.col("last_pos") == F.col("_n") - 1
    own = F.slice(ids, (F.col("first_pos") + 1).cast("int"), (F.col("last_pos") - F.col("first_pos") + 1).cast("int"))
    none = F.array().cast("array<int>")
    return cut.select(*keys, "piece", F.concat(F.when(F.col("piece") == 0, F.array(F.lit(bos))).otherwise(none), own, F.when(last, F.array(F.lit(eos))).otherwise(none)).alias("ids"))
