"""Queries of events beside the notes, of errors, and of the remaining corruption modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.operators import corrupt, events, grammar, grid, preprocess, score
from tonegrid.plans import base, music, sets
from tonegrid.plans.base import GRID, SIGNATURES
from tonegrid.plans.sets import SEQ, _BARRED, _barred, _u

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _signatures(spark, sf, every: bool = False) -> DataFrame:
    return events.grid_signatures(base.signatures(spark, sf, every), base.tpq(spark, sf))


_TSG = f"{SIGNATURES}, tsg as (select score_id, (time * 8 // tpq)::bigint as time, num, den from tsn join sc using (score_id))"


def _inner(name: str) -> str:
    """A query's SQL as a subquery."""
    return f"({music.SQL[name]})"


@query(f"""with {base.RAW}, {_TSG}, a as (select score_id, time, 0 k, 'TimeSig' as type, num || '/' || den as value from tsg union all select score_id, time, 1, 'Tempo', printf('%.2f', tempo) from {_inner('tempo_quantize')})
  select score_id, time, row_number() over (partition by score_id order by time, k, value) as ord, type, value from a""")
def global_events(spark, sf):
    return events.global_events(_signatures(spark, sf), preprocess.quantize_tempos(score.tempos(base.raw(spark, sf)), base.tpq(spark, sf)))


@query(f"""with p as (select score_id, track_idx, time, duration from {_inner('pedal_merge')}) select score_id, track_idx, time, 'Pedal' as type, 'None' as value from p union all
  select score_id, track_idx, time + duration, 'PedalOff', 'None' from p union all select score_id, track_idx, time, 'PitchBend', value::varchar from {_inner('pitch_bend_dedup')}""")
def effect_events(spark, sf):
    pedals = preprocess.merge_pedals(score.pedals(base.raw(spark, sf)))
    return events.effect_events(pedals, preprocess.quantize_bends(score.pitch_bends(base.raw(spark, sf)), base.tpq(spark, sf)))


_RTS = f"""{GRID}, {_TSG}, me as (select score_id, max(time) mt from gr group by score_id),
s1 as (select t.*, mt, lead(t.time) over (partition by t.score_id order by t.time) nx from tsg t join me using (score_id)),
bt as (select score_id, unnest(generate_series(time, least(coalesce(nx, mt + 1), mt + 1) - 1, (32 // den) * num)) tick, num, den from s1 where least(coalesce(nx, mt + 1), mt + 1) > time),
ba as (select *, row_number() over (partition by score_id order by tick) - 1 as bar, lead(tick) over (partition by score_id order by tick) tn from bt),
nb as (select n.*, b.bar, b.tick from grn n join ba b on b.score_id = n.score_id and n.time >= b.tick and (b.tn is null or n.time < b.tn)),
lb as (select score_id, track_idx, max(bar) l from nb group by all),
al as (select lb.score_id, lb.track_idx, ba.bar, 0::bigint n, ['Bar_None', 'TimeSig_' || num || '/' || den] tokens from ba join lb on lb.score_id = ba.score_id and ba.bar <= l union all
  select score_id, track_idx, bar, nord, list_concat(case when lt is null or lt <> time then ['Position_' || (time - tick)] else [] end, [{music._TRIPLE}]) from (select *, lag(time) over (partition by score_id, track_idx order by nord) lt from nb)),
rts as ({music._places('select score_id, track_idx, bar, n, tokens from al', 'bar, n')})"""


def _grid_with_bars(spark, sf) -> tuple[DataFrame, DataFrame]:
    notes = base.grid_notes(spark, sf)
    ends = grid.last_onset(notes)
    bars = grid.bars(_signatures(spark, sf, True), ends.select("score_id", F.lit(8).alias("tpq")), ends)
    return grid.with_bar(notes, bars), bars


@query(f"with {_RTS} select score_id, track_idx, ord, token from rts")
def remi_signatures_encode(spark, sf):
    notes, bars = _grid_with_bars(spark, sf)
    return events.encode_remi_signatures(notes.where("bar is not null").drop("tick", "num", "den"), bars)


@query(f"""with t as (select * from {_inner('midilike_encode')}), a as (select score_id, track_idx, ord, split_part(token, '_', 1) k, split_part(token, '_', 2) p from t),
  b as (select *, case when k like '%On' then 1 else -1 end d from a where k in ('NoteOn', 'DrumOn', 'NoteOff', 'DrumOff')), c as (select *, sum(d) over (partition by score_id, track_idx, k like 'Drum%', p order by ord) s from b),
  e as (select score_id, track_idx, k like 'Drum%' dr, p, least(0, min(s)) m, sum(d) s from c group by all) select score_id, track_idx, sum(-m)::bigint as n_unstarted, sum(s - m)::bigint as n_unended from e group by score_id, track_idx""")
def midilike_errors_all(spark, sf):
    return events.midilike_errors(grammar.encode_midilike(base.grid_notes(spark, sf)))


@query(f"""with t as (select *, split_part(bar, '_', 2)::bigint * 1000 + split_part(position, '_', 2)::bigint a from {_inner('octuple_encode')}), u as (select *, coalesce(a < lag(a) over (partition by score_id, track_idx order by ord), false) x, row_number() over (partition by score_id, track_idx, a, pitch order by ord) > 1 y from t)
  select score_id, track_idx, count(*) as n_rows, sum(case when x or y then 1 else 0 end)::bigint as n_errors from u group by score_id, track_idx""")
def octuple_errors(spark, sf):
    return events.octuple_errors(grammar.encode_octuple(base.grid_notes(spark, sf)))


@query(f"""with t as (select * from {_inner('cpword_encode')}), a as (select *, sum(case when position = 'Bar_None' then 1 else 0 end) over w b, case when position like 'Position%' then split_part(position, '_', 2)::int end p, family = 'Family_Note' note from t window w as (partition by score_id, track_idx order by ord)),
  c as (select *, sum(case when p is not null then 1 else 0 end) over (partition by score_id, track_idx order by ord) o from a),
  e as (select *, coalesce(p <= max(p) over (partition by score_id, track_idx, b order by ord rows between unbounded preceding and 1 preceding), false) x, row_number() over (partition by score_id, track_idx, o, note, pitch order by ord) r from c)
  select score_id, track_idx, count(*) as n_rows, sum(case when x or (note and (r > 1 or o = 0)) then 1 else 0 end)::bigint as n_errors from e group by score_id, track_idx""")
def cpword_errors_all(spark, sf):
    return events.cpword_errors(grammar.encode_cpword(base.grid_notes(spark, sf)))


# beats of a bar: what stands between two positions that are multiples of 8 (ids 10..41 are positions 0..31)

_BEAT = "*, bar * 10 + coalesce(max(case when id between 10 and 41 then (id - 10) // 8 + 1 end) over (partition by score_id, seq_id, bar order by pos), 0) beat"
_BEATED = f"{_BARRED}, bb as (select {_BEAT} from br)"


def _beated(spark, sf) -> DataFrame:
    return corrupt.with_beats(_barred(spark, sf), SEQ, 10, 41, 8)


@query(f"with {_BEATED} select score_id, seq_id, n, pos, id, bar, beat from bb where beat = 0 or {_u(1, 'score_id', 'seq_id', 'beat')} >= 0.3")
def beat_drop(spark, sf):
    return corrupt.drop_units(_beated(spark, sf), SEQ, "beat", 0.3)


@query(f"with {_BEATED} select score_id, seq_id, row_number() over (partition by score_id, seq_id order by bar, case when beat % 10 > 0 then {_u(1, 'score_id', 'seq_id', 'beat')} else -1 end, beat, pos) as ord, id from bb")
def beat_permute(spark, sf):
    return corrupt.permute_within(_beated(spark, sf), SEQ, "bar", "beat", 10)


@query(f"with {_BARRED}, k as (select *, {_u(1, 'score_id', 'bar')} u from br) select score_id, seq_id, n, pos, id, bar from k where bar = 0 or u >= 0.3")
def aligned_drop(spark, sf):
    return corrupt.drop_aligned(_barred(spark, sf), "score_id", "bar", 0.3)


@query(f"""with {sets._SEQS}, {sets._POS}, a as (select *, case when id between 42 and 130 then 1 else 0 end st from ps), b as (select *, sum(st) over (partition by score_id, seq_id order by pos)::bigint note from a)
  select score_id, seq_id, n, pos, id, note from b where note = 0 or id not between 42 and 220 or {_u(1, 'score_id', 'seq_id', 'note')} >= 0.2""")
def note_drop(spark, sf):
    return corrupt.drop_notes(sets._rows(spark, sf), SEQ, (42, 130), (42, 220), 0.2)
