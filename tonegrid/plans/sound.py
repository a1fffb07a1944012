"""Queries on the raw events of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.operators.intervals import periods_and_gaps
from tonegrid.operators.notes import pair_notes
from tonegrid.plans.base import NOTES
from tonegrid.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of sound and the gaps between them, for each track and channel of raw_events."""
    notes = pair_notes(table(spark, sf_dir, "raw_events"), velocity=False)
    notes = notes.select("score_id", "track_idx", "channel", "tick", (F.col("tick") + F.col("duration")).alias("stop"))
    found = periods_and_gaps(notes, ["score_id", "track_idx", "channel"], "tick", "stop")
    return found.select("score_id", "track_idx", "channel", "kind", F.col("tick").alias("start_tick"), F.col("stop").alias("end_tick"))


P3_SQL = f"""with {NOTES}, iv as (select score_id, track_idx, channel, time s, time + duration e from nt),
a as (select *, max(e) over (partition by score_id, track_idx, channel order by s, e rows between unbounded preceding and 1 preceding) r from iv),
b as (select *, sum(case when r >= s then 0 else 1 end) over (partition by score_id, track_idx, channel order by s, e rows unbounded preceding) g from a),
p as (select score_id, track_idx, channel, min(s) s, max(e) e from b group by score_id, track_idx, channel, g),
q as (select *, lead(s) over (partition by score_id, track_idx, channel order by s) nx from p)
select score_id, track_idx, channel, 'period' as kind, s as start_tick, e::bigint as end_tick from q union all
select score_id, track_idx, channel, 'gap', e::bigint, nx from q where nx is not null"""
