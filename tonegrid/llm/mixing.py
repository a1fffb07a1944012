"""Mixing sources to target weights (p9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.functions import uniform
from tonegrid.llm.bpe import TOKENIZERS, VOCABULARY, count_tokens
from tonegrid.session import materialize


def water_fill(tokens: dict[str, int], share: dict[str, float], most: dict[str, int]) -> dict[str, tuple[float, bool, bool]]:
    """For each source: how often its documents are used on average, whether its target is out of reach at its cap, and whether it is clamped.

    The mixture has as many tokens as all sources together. In each round, the sources whose part exceeds their tokens times their cap are clamped
    there, and what they lack goes to the others in proportion to their shares, until all fit or all are clamped. The parts of the first round are
    the targets themselves, so the sources clamped in it are those whose targets are out of reach.
    """
    total = sum(tokens.values())
    part, clamped, short = {s: share[s] * total for s in tokens}, set(), None
    while True:
        more = {s for s, aim in part.items() if most[s] * tokens[s] < aim}
        short = more if short is None else short
        clamped |= more
        free = {s: share[s] for s in tokens if s not in clamped}
        left, weight = total - sum(most[s] * tokens[s] for s in clamped), sum(free.values())
        part = {s: left * w / weight if weight else 0.0 for s, w in free.items()}
        if not any(most[s] * tokens[s] < aim for s, aim in part.items()):
            break
    return {s: (float(most[s]) if s in clamped else max(0.0, part[s]) / tokens[s] if tokens[s] else 0.0, s in short, s in clamped) for s in tokens}


def counted(docs: DataFrame, targets: DataFrame, keep: list[str], text: str = "text", source: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep`, source and n_tokens of the documents whose source is in `targets`; null and empty texts have no tokens."""
    named = targets.select(F.col("source").alias("_source")).where("_source is not null").distinct()
    own = docs.join(named, F.col(source) == F.col("_source"), "left_semi").select(*[F.col(c) for c in keep], F.col(source).alias("_s"), F.col(text).alias("_text"))
    return count_tokens(own, "_text", [*keep, "_s"], folder, vocabulary).withColumnRenamed("_s", "source")


def source_plan(docs: DataFrame, targets: DataFrame, text: str = "text", source: str = "source", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, n_docs, n_tokens, target_share, max_repeats, repeats, short, clamped, planned_share): one row for each source of `targets`.

    n_tokens are the ids of all documents of the source. short: max_repeats * n_tokens is less than target_share of the tokens of all
    sources in `targets`. Documents of other or null sources aren't counted; a source without documents has 0 tokens. Null and empty texts have
    no tokens. Sources are summed where the documents are, so a source of a third of all rows sends a row a task.
    """
    return plan_of(counted(docs, targets, [], text, source, folder, vocabulary), targets)


def plan_of(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source_plan() of documents whose tokens are counted already: sizes has source and n_tokens of each."""
    named = targets.select(F.col("source"), "target_share", "max_repeats").where("source is not null")
    sums = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums = named.join(sums, "source", "left").select("source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "target_share", "max_repeats")

    def fill(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in it if len(pdf)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        by = rows.set_index("source")
        plan = water_fill(by.n_tokens.to_dict(), by.target_share.to_dict(), by.max_repeats.to_dict())
        for i, name in enumerate(("repeats", "short", "clamped")):
            rows[name] = [plan[s][i] for s in rows.source]
        used = rows.repeats * rows.n_tokens
        rows["planned_share"] = used / used.sum() if used.sum() else 0.0
        yield rows

    schema = "source string, n_docs bigint, n_tokens bigint, target_share double, max_repeats int, repeats double, short boolean, clamped boolean, planned_share double"
    return sums.coalesce(1).mapInPandas(fill, schema)  # one row a source


def mixture(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """(key, source, copies): how often each document is in the mixture, at least once.

    repeats = w + f: each document is used w times, and once more if its seeded uniform number is below f. The result depends on
    key and seed alone, not on partitions. The plan has one row a source; it is joined by source, and broadcast only if its size is small.
    """
    return _drawn(docs.select(F.col(key), F.col(source).alias("source")), plan, key, seed).select(key, "source", "copies")


def _drawn(docs: DataFrame, plan: DataFrame, key: str, seed: int) -> DataFrame:
    d = docs.join(plan.select("source", "repeats", "max_repeats"), "source")
    whole = F.floor("repeats")
    copies = F.least(whole + (uniform(seed, key) < F.col("repeats") - whole).cast("int"), F.col("max_repeats")).cast("int")
    return d.withColumn("copies", copies).where("copies > 0")


def mixed(docs: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 1, **names: str) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, copies), and the shares that it reaches: the columns of source_plan(), used_tokens and reached_share.

    reached_share is that of the documents drawn, copies counted; without any it is 0. Texts are encoded once: their counts are a table of the shared folder.
    """
    sizes = materialize(counted(docs, targets, [key], **names))
    plan = materialize(plan_of(sizes, targets))
    drawn = _drawn(sizes, plan, key, seed)
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    every = used.agg(F.sum("used_tokens").alias("every"))
    shares = plan.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    shares = shares.withColumn("reached_share", F.coalesce(F.col("used_tokens") / F.nullif(every.scalar(), F.lit(0)), F.lit(0.0)))
    return drawn.select(key, "source", "copies"), shares
