"""Queries that write whole scores as tokens and read them back, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonegrid.config import type_graph
from tonegrid.operators import grammar, restore, stream
from tonegrid.operators.pipeline import Switches
from tonegrid.plans import base, music, streams
from tonegrid.plans.base import GRID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_ALL = Switches(signatures=True, tempos=True, pedals=True, bends=True, programs=True, one_stream=True)
# bars, and so signatures and effects, are written as far as there are items; all items of a score with notes are
_BACK = f"""with {streams.tables_sql(_ALL)}, pg as (select distinct score_id, track_idx, program from nn), sn as (select distinct score_id from nn)
select score_id, 'note' as kind, program::bigint as program, time, duration as a, pitch::bigint as b, velocity::bigint as c from nn
union all select p.score_id, 'pedal', program, time, duration, null, null from pp p join pg using (score_id, track_idx) union all select b.score_id, 'bend', program, time, value, null, null from pb b join pg using (score_id, track_idx)
union all select t.score_id, 'signature', null, time, num, den, null from tsn t join sn using (score_id) union all select t.score_id, 'tempo', null, time, round(tempo * 100)::bigint, null, null from te t join sn using (score_id)"""


@query(_BACK)
def remi_whole_decode(spark, sf):
    return restore.restore_remi(stream.encode_remi(streams.prepared(spark, sf, _ALL), _ALL), ["score_id"])


@query(_BACK)
def tsd_whole_decode(spark, sf):
    return restore.restore_tsd(stream.encode_tsd(streams.prepared(spark, sf, _ALL), _ALL), ["score_id"])


@query(f"""with {GRID}, k as (select *, dense_rank() over (partition by score_id order by track_idx) - 1 as track from gr)
  select score_id, track, program, is_drum, time::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from k""")
def mmm_decode(spark, sf):
    return restore.decode_mmm(grammar.encode_mmm(base.grid_notes(spark, sf)))


@query(f"""with t as ({music.SQL['pertok_encode']}), a as (select *, split_part(token, '_', 1) k, split_part(token, '_', 2) v, sum(case when token = 'Bar_None' then 1 else 0 end) over w - 1 bar from t window w as (partition by score_id, track_idx order by ord)),
  b as (select *, lag(v, 2) over w p, lag(v) over w m, lead(v) over w ve, lead(v, 2) over w du from a window w as (partition by score_id, track_idx order by ord))
  select score_id, track_idx, k = 'PitchDrum' as is_drum, greatest(0, round_even((bar * 32 + p::bigint) * 27.5::double + m::bigint * {110 / 109!r}::double - 55.0::double, 0))::bigint as time, du::bigint as duration, v::int as pitch, ve::bigint as velocity from b where k in ('Pitch', 'PitchDrum')""")
def pertok_decode(spark, sf):
    return restore.decode_pertok(music.pertok_encode(spark, sf))


@query(f"""with t as ({music.SQL['mumidi_encode']}), a as (select *, split_part(bar, '_', 2)::bigint * 1000 + coalesce(try_cast(split_part(position, '_', 2) as bigint), -1) a, last_value(case when token like 'Program%' then token end ignore nulls) over (partition by score_id order by ord rows unbounded preceding) p from t),
  b as (select *, coalesce(a < max(a) over (partition by score_id order by ord rows between unbounded preceding and 1 preceding), false) x, velocity is not null and row_number() over (partition by score_id, a, p, token, velocity is not null order by ord) > 1 y from a)
  select score_id, count(*) as n_rows, sum(case when x or y then 1 else 0 end)::bigint as n_errors from b group by score_id""")
def mumidi_errors(spark, sf):
    return restore.mumidi_errors(grammar.encode_mumidi(base.grid_notes(spark, sf)))


@query(f"""with e as ({music.SQL['remi_errors']}) select score_id, dense_rank() over (partition by score_id order by track_idx) - 1 as track, n_tokens, n_type_errors, n_time_errors, n_note_errors from e""")
def mmm_errors(spark, sf):
    return restore.mmm_errors(grammar.encode_mmm(base.grid_notes(spark, sf)), type_graph("remi"))
