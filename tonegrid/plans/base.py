"""Tables that many queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.operators import preprocess, score
from tonegrid.session import table  # noqa: F401


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_events")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.once_loaded(table(spark, sf_dir, "scores"), "score_id")


def tpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("tpq > 0").select("score_id", "tpq")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks once; rows that come twice have equal contents."""
    return table(spark, sf_dir, "tracks").groupBy("score_id", "track_idx").agg(F.min("program").alias("program"), F.max("is_drum").alias("is_drum"), F.min("name").alias("name"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.notes(raw(spark, sf_dir))


def grid_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on the default grid."""
    return preprocess.preprocess(notes(spark, sf_dir), tpq(spark, sf_dir), tracks(spark, sf_dir))


def signatures(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """Time signatures by score, normalized: on bar starts, from tick 0 on. every: 4/4 for scores without a supported one."""
    return preprocess.normalize_signatures(preprocess.supported_signatures(score.time_signatures(raw(spark, sf_dir))), tpq(spark, sf_dir), every)


def _pairs(events: str, name: str, on: str) -> str:
    """First with first pairs of the rows of a view with columns score_id, track_idx, channel, pitch, ord, tick, velocity."""
    key = "score_id, track_idx, channel, pitch"
    return f"""
{name}_1 as (select *, case when {on} then 1 else -1 end as d from {events}),
{name}_2 as (select *, sum(d) over (partition by {key} order by ord) s, sum(case when d > 0 then 1 else 0 end) over (partition by {key} order by ord) ons from {name}_1),
{name}_3 as (select *, least(0, min(s) over (partition by {key} order by ord)) m, least(0, coalesce(min(s) over (partition by {key} order by ord rows between unbounded preceding and 1 preceding), 0)) pm from {name}_2),
{name}_4 as (select *, case when d > 0 then ons else ons - s + m end k from {name}_3 where d > 0 or m = pm),
{name} as (select score_id, track_idx, channel, pitch, max(case when d > 0 then ord end) ord, max(case when d > 0 then tick end) as time,
  greatest(1, coalesce(max(case when d < 0 then tick end) - max(case when d > 0 then tick end), 1)) as duration, max(case when d > 0 then velocity end) velocity
  from {name}_4 group by score_id, track_idx, channel, pitch, k having max(d) = 1)"""


RAW = """ev as (select * exclude (n) from (select *, row_number() over (partition by score_id, track_idx, ord order by loaded_at) n from raw_events) where n = 1),
sc as (select score_id, tpq from (select *, row_number() over (partition by score_id order by loaded_at) n from scores) where n = 1 and tpq > 0),
tr as (select score_id, track_idx, min(program) program, max(is_drum) is_drum, min(name) name from tracks group by score_id, track_idx)"""
NOTES = (
    RAW
    + """,
note_ev as (select score_id, track_idx, channel, pitch, ord, tick, coalesce(velocity, 0) velocity, event_type from ev
  where event_type in ('NoteOn', 'NoteOff') and ord is not null and tick is not null and pitch is not null),"""
    + _pairs("note_ev", "nt", "event_type = 'NoteOn' and velocity > 0")
)
GRID = (
    NOTES
    + """,
gr_1 as (select n.score_id, n.track_idx, coalesce(t.is_drum, false) is_drum, case when coalesce(t.is_drum, false) then -1 else coalesce(t.program, 0) end program,
  round_even(n.time * 8 / s.tpq, 0)::bigint as time, greatest(1, round_even(n.duration * 8 / s.tpq, 0)::bigint) d, n.pitch, n.velocity
  from nt n join sc s using (score_id) left join tr t using (score_id, track_idx)),
gr as (select score_id, track_idx, program, is_drum, time, case when d <= 32 then d when d >= 96 then 96 else d + d % 2 end as duration, pitch, 4 * greatest(1, (velocity + 3) // 4) - 1 as velocity
  from gr_1 where (is_drum and pitch between 27 and 88) or (not is_drum and pitch between 21 and 109)),
grn as (select *, row_number() over (partition by score_id, track_idx order by time, duration, pitch, velocity) nord from gr)"""
)
PEDALS = (
    RAW
    + """,
pedal_ev as (select score_id, track_idx, channel, 0 as pitch, ord, tick, 1 as velocity, value from ev where event_type = 'ControlChange' and controller = 64 and value is not null and tick is not null and ord is not null),"""
    + _pairs("pedal_ev", "pd", "value >= 64")
)
SIGNATURES = """ts_raw as (select distinct score_id, tick as time, numerator num, denominator den from raw_events where event_type = 'TimeSignature' and tick is not null
  and (numerator, denominator) in ((3, 8), (12, 8), (6, 8), (5, 4), (6, 4), (3, 4), (2, 4), (1, 4), (4, 4))),
ts_o as (select t.*, s.tpq, row_number() over (partition by score_id order by t.time, num, den) i from ts_raw t join sc s using (score_id)),
ts_f as (
  with recursive r as (
    select score_id, tpq, 0::bigint i, [{'time': 0::bigint, 'num': 4::int, 'den': 4::int}] acc from (select distinct score_id, tpq from ts_o)
    union all
    select r.score_id, r.tpq, r.i + 1,
      case when o.num = r.acc[-1].num and o.den = r.acc[-1].den then r.acc
           when z.at <= r.acc[-1].time then list_append(r.acc[1:len(r.acc) - 1], {'time': z.at, 'num': o.num, 'den': o.den})
           else list_append(r.acc, {'time': z.at, 'num': o.num, 'den': o.den}) end
    from r join ts_o o on o.score_id = r.score_id and o.i = r.i + 1,
    lateral (select r.acc[-1].time + ceil((o.time - r.acc[-1].time) / ((r.tpq * 4 // r.acc[-1].den) * r.acc[-1].num))::bigint * ((r.tpq * 4 // r.acc[-1].den) * r.acc[-1].num) as at) z
  ) select score_id, max_by(acc, i) acc from r group by score_id),
tsn as (select score_id, x.time as time, x.num as num, x.den as den from (select score_id, unnest(acc) x from ts_f))"""
