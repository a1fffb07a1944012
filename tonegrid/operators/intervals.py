"""Intervals per entity: merging into continuous periods, and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Units of a time shard. A unit is an exact integer (a tick).
SHARD = 1 << 16


def periods_and_gaps(
    df: DataFrame, entity: Sequence[str], start: str, end: str, shard: int = SHARD, kind: str = "kind"
) -> DataFrame:
    """Merges the half-open intervals [start, end) of each entity and lists the gaps between the merged periods.

    Time is cut into shards of `shard` units. In each (entity, shard) the intervals set the units of a bitmap, which is run-length
    compressed throughout: its runs of set units, found by a sweep over the sorted pieces; no unit is ever a bit of its own. The shuffle and
    the sort are by (entity, shard), so an entity that holds a third of all rows is spread over its shards. An interval makes two pieces, in its
    first and last shard, and one stretch of whole shards between them, however many they are; shards inside such a stretch add nothing.
    Between shards only two numbers a shard count: where its first run starts and where its last run ends. Carrying those along the shards of
    an entity gives the set runs (`period`) and the clear runs between them (`gap`).

    Result: the entity's columns, kind ('period' or 'gap'), start, end (exclusive). Null entity values form their own entity.
    Intervals with a null bound or without length are ignored. Touching intervals belong together. An empty table gives no rows.
    Repeated rows change nothing. Other columns are dropped.
    """
    keys = [f"_e{i}" for i in range(len(entity))]
    d = df.select(*[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_t"))
    d = d.where("_s < _t")
    first, last = F.floor(F.col("_s") / F.lit(shard)), F.floor((F.col("_t") - 1) / F.lit(shard))
    piece = lambda b, s, t, whole: F.struct(b.alias("_b"), s.alias("_s"), t.alias("_t"), F.lit(whole).alias("_w"))
    pieces = F.when(first == last, F.array(piece(first, F.col("_s"), F.col("_t"), 0))).when(last == first + 1, F.array(piece(first, F.col("_s"), last * shard, 0), piece(last, last * shard, F.col("_t"), 0)))
    pieces = pieces.otherwise(F.array(piece(first, F.col("_s"), (first + 1) * shard, 0), piece(first + 1, (first + 1) * shard, last * shard, 1), piece(last, last * shard, F.col("_t"), 0)))
    d = d.select(*keys, F.inline(pieces))

    # runs of set units of one shard
    by_shard = Window.partitionBy(*keys, "_b", "_w").orderBy("_s", "_t")
    reach = F.max("_t").over(by_shard.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_new", F.when(reach >= F.col("_s"), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_new").over(by_shard.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.groupBy(*keys, "_b", "_w", "_run").agg(F.min("_s").alias("_s"), F.max("_t").alias("_t"))
    runs = runs.groupBy(*keys, "_b", "_w").agg(F.array_sort(F.collect_list(F.struct("_s", "_t"))).alias("_runs"))  # at most shard / 2 runs

    # one row a shard or stretch from here on; a stretch comes before the shard that it starts with
    along = Window.partitionBy(*keys).orderBy("_b", F.col("_w").desc())
    n = F.size("_runs")
    runs = runs.withColumn("_cover", F.max(F.when(F.col("_w") == 1, F.col("_runs")[0]["_t"])).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    bound = F.when(F.col("_w") == 1, F.col("_runs")[0]["_t"]).otherwise((F.col("_b") + 1) * shard)
    runs = runs.where(F.col("_cover").isNull() | (F.col("_cover") < bound))
    cut = F.array(F.struct(F.greatest(F.col("_runs")[0]["_s"], "_cover").alias("_s"), F.col("_runs")[0]["_t"].alias("_t")))
    runs = runs.withColumn("_runs", F.when(F.col("_w") == 1, cut).otherwise(F.col("_runs")))
    runs = runs.select(*keys, "_b", "_w", "_runs", n.alias("_n"), F.col("_runs")[0]["_s"].alias("_first"), F.col("_runs")[n - 1]["_s"].alias("_tail"), F.col("_runs")[n - 1]["_t"].alias("_last"))
    runs = runs.withColumn("_joined", F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False)))
    runs = runs.withColumn("_carry", F.when(~(F.col("_joined") & (F.col("_n") == 1)), F.col("_tail")))  # where the shard's last period began, unless before it
    runs = runs.withColumn("_open", F.last("_carry", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("_next", F.lead("_first").over(along))
    following = F.concat(F.transform(F.slice("_runs", 2, F.col("_n")), lambda r: r["_s"]), F.array("_next"))
    d = runs.select(*keys, "_joined", "_open", F.posexplode(F.arrays_zip("_runs", following.alias("_then"))).alias("_i", "_z"))
    begin = F.when((F.col("_i") == 0) & F.col("_joined"), F.col("_open")).otherwise(F.col("_z._runs._s"))
    d = d.select(*keys, begin.alias("_s"), F.col("_z._runs._t").alias("_t"), F.col("_z._then").alias("_next"))
    d = d.where("_next is null or _next > _t")  # else the period goes on in the next shard
    made = F.array(
        F.struct(F.lit("period").alias("k"), F.col("_s").alias("s"), F.col("_t").alias("t")),
        F.struct(F.lit("gap").alias("k"), F.col("_t").alias("s"), F.col("_next").alias("t")),
    )
    d = d.select(*keys, F.explode(made).alias("_m")).where("_m.t is not null")
    return d.select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], F.col("_m.k").alias(kind), F.col("_m.s").alias(start), F.col("_m.t").alias(end))
