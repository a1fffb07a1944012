"""Queries of scores, grids and grammars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, type_graph, vocabulary
from tonegrid.functions import greedy, velocity_bin
from tonegrid.operators import grammar, grid, preprocess, score
from tonegrid.plans import base
from tonegrid.plans.base import GRID, NOTES, PEDALS, RAW, SIGNATURES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# scores


@query(f"with {NOTES} select score_id, track_idx, channel, pitch, ord, time as tick, duration::bigint as duration, velocity from nt")
def pair_notes(spark, sf):
    return score.pair_notes(base.raw(spark, sf)).withColumn("duration", F.col("duration").cast("bigint"))


@query(f"with {PEDALS} select score_id, track_idx, time, duration::bigint as duration from pd")
def pair_pedals(spark, sf):
    return score.pedals(base.raw(spark, sf))


@query("select distinct score_id, tick as time, usec_per_quarter as usec from raw_events where event_type = 'Tempo' and tick is not null")
def meta_tempos(spark, sf):
    return score.tempos(base.raw(spark, sf))


@query("select distinct score_id, tick as time, numerator as num, denominator as den from raw_events where event_type = 'TimeSignature' and tick is not null")
def meta_time_signatures(spark, sf):
    return score.time_signatures(base.raw(spark, sf))


@query("""select distinct score_id, tick as time, "key" as "key", "scale" as tonality from raw_events where event_type = 'KeySignature' and tick is not null""")
def meta_key_signatures(spark, sf):
    return score.key_signatures(base.raw(spark, sf))


@query(f"with {RAW} select score_id, track_idx, ord, tick as time, value - 8192 as value from ev where event_type = 'PitchBend' and tick is not null")
def pitch_bends(spark, sf):
    return score.pitch_bends(base.raw(spark, sf))


@query(f"with {RAW} select score_id, track_idx, ord, tick as time, controller as number, value from ev where event_type = 'ControlChange' and tick is not null and controller <> 64")
def control_changes(spark, sf):
    return score.controls(base.raw(spark, sf))


@query("""select score_id, track_idx, case when c = 9 then -1 else coalesce(p, 0) end as program from (select score_id, track_idx,
  arg_min(program, ord) filter (event_type = 'ProgramChange') p, arg_min(channel, ord) filter (channel is not null) c from raw_events group by score_id, track_idx)""")
def track_programs(spark, sf):
    return score.programs(base.raw(spark, sf))


_ON = "case when event_type = 'NoteOn' and coalesce(velocity, 0) > 0 then 1 else 0 end"


@query(f"""with {RAW} select score_id, track_idx, row_number() over (partition by score_id, track_idx order by case when event_type = 'EndOfTrack' then 1 else 0 end, tick, {_ON}, ord) as pos,
  ord, tick, event_type from ev where tick is not null""")
def track_sort(spark, sf):
    return score.track_order(base.raw(spark, sf))


@query(f"""with {RAW}, pr as (select score_id, track_idx, case when c = 9 then -1 else coalesce(p, 0) end as program from (select score_id, track_idx,
  arg_min(program, ord) filter (event_type = 'ProgramChange') p, arg_min(channel, ord) filter (channel is not null) c from raw_events group by score_id, track_idx))
  select score_id, pr.program, row_number() over (partition by score_id, pr.program order by case when event_type = 'EndOfTrack' then 1 else 0 end, tick, {_ON}, track_idx, ord) as pos,
  track_idx, ord, tick, event_type from ev join pr using (score_id, track_idx) where tick is not null""")
def merge_by_program(spark, sf):
    return score.merge_by_program(base.raw(spark, sf))


@query(f"with {RAW} select score_id, track_idx, case when is_drum then -1 else coalesce(program, 0) end as program, coalesce(is_drum, false) as is_drum from tr")
def score_programs(spark, sf):
    drum = F.coalesce("is_drum", F.lit(False))
    return base.tracks(spark, sf).select("score_id", "track_idx", F.when(drum, -1).otherwise(F.coalesce("program", F.lit(0))).alias("program"), drum.alias("is_drum"))


# preprocessing


@query(f"""with {NOTES} select score_id, track_idx, round_even(n.time * 8 / tpq, 0)::bigint as time, greatest(1, round_even(duration * 8 / tpq, 0)::bigint)::bigint as duration,
  pitch, n.velocity from nt n join sc using (score_id)""")
def resample_quantize(spark, sf):
    return preprocess.resample(base.notes(spark, sf), base.tpq(spark, sf))


@query(f"""with {NOTES} select score_id, track_idx, n.time, n.pitch from nt n left join tr t using (score_id, track_idx)
  where (coalesce(is_drum, false) and pitch between 27 and 88) or (not coalesce(is_drum, false) and pitch between 21 and 109)""")
def pitch_range(spark, sf):
    d = base.notes(spark, sf).join(base.tracks(spark, sf).select("score_id", "track_idx", "is_drum"), ["score_id", "track_idx"], "left")
    return preprocess.in_pitch_range(d).select("score_id", "track_idx", "time", "pitch")


@query(f"with {NOTES} select score_id, track_idx, n.time, n.pitch, (4 * greatest(1, (velocity + 3) // 4) - 1)::bigint as velocity from nt n")
def velocity_quantize(spark, sf):
    return base.notes(spark, sf).select("score_id", "track_idx", "time", "pitch", velocity_bin(F.col("velocity"), DEFAULT.velocities).alias("velocity"))


@query(f"""with {NOTES}, r as (select score_id, track_idx, n.time, pitch, greatest(1, round_even(duration * 8 / tpq, 0)::bigint)::bigint d from nt n join sc using (score_id))
  select score_id, track_idx, r.time, pitch, case when d <= 32 then d when d >= 96 then 96 else d + d % 2 end::bigint as duration from r""")
def duration_quantize(spark, sf):
    d = base.notes(spark, sf).join(base.tpq(spark, sf), "score_id")
    d = d.withColumn("duration", F.greatest(F.lit(1), F.rint(F.col("duration") * 8 / F.col("tpq")).cast("bigint")))
    return preprocess.quantize_duration(d).select("score_id", "track_idx", "time", "pitch", "duration")


_G = "score_id, track_idx, program, is_drum, time::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity"


@query(f"with {GRID} select {_G} from gr")
def preprocess_notes(spark, sf):
    return base.grid_notes(spark, sf)


@query(f"with {GRID}, u as (select *, row_number() over (partition by score_id, track_idx, time, pitch order by duration, velocity) k from gr) select {_G} from u where k = 1")
def dedup_notes(spark, sf):
    return preprocess.drop_duplicates(base.grid_notes(spark, sf))


@query(f"""with {GRID}, u as (select * exclude (duration), duration as d0, lead(time) over (partition by score_id, track_idx, pitch order by time, duration, velocity) nx from gr),
  w as (select *, case when nx <= time + d0 then nx - time else d0 end as duration from u) select {_G} from w""")
def fix_overlaps(spark, sf):
    return preprocess.fix_overlaps(base.grid_notes(spark, sf))


@query("""with s as (select score_id, max(denominator) d from raw_events where event_type = 'TimeSignature' and tick is not null group by score_id)
  select score_id, (8 * greatest(4, d) / 4)::bigint as tpq from s""")
def target_tpq(spark, sf):
    return preprocess.target_tpq(score.time_signatures(base.raw(spark, sf)))


@query("""select distinct score_id, tick as time, numerator as num, denominator as den from raw_events where event_type = 'TimeSignature' and tick is not null
  and (numerator, denominator) in ((3, 8), (12, 8), (6, 8), (5, 4), (6, 4), (3, 4), (2, 4), (1, 4), (4, 4))""")
def filter_time_signatures(spark, sf):
    return preprocess.supported_signatures(score.time_signatures(base.raw(spark, sf)))


@query(f"with {RAW}, {SIGNATURES} select score_id, time, num, den from tsn")
def time_signature_normalize(spark, sf):
    return base.signatures(spark, sf)


@query(f"""with {RAW}, {SIGNATURES}, b as (select score_id, time, (tpq * 4 // den)::bigint as tb from tsn join sc using (score_id)),
  c as (select *, lag(tb) over (partition by score_id order by time) p from b), d as (select * from c where p is null or p <> tb)
  select score_id, time, lead(time) over (partition by score_id order by time) as until, tb as ticks_per_beat from d""")
def beat_sections(spark, sf):
    return preprocess.sections(base.signatures(spark, sf), base.tpq(spark, sf))


def _tempo_case() -> str:
    t = sorted((60e6 / x, x) for x in DEFAULT.tempos)
    return "case " + " ".join(f"when usec * 2 < {a + b!r} then {x!r}" for (a, x), (b, _) in zip(t, t[1:])) + f" else {t[-1][1]!r} end"


@query(f"""with {RAW}, t as (select distinct score_id, tick, usec_per_quarter usec from raw_events where event_type = 'Tempo' and tick is not null and usec_per_quarter > 0),
  q as (select score_id, round_even(tick * 8 / tpq, 0)::bigint as time, tick, usec from t join sc using (score_id)),
  l as (select score_id, time, usec from (select *, row_number() over (partition by score_id, time order by tick desc, usec desc) n from q) where n = 1),
  v as (select score_id, time, ({_tempo_case()})::double as tempo from l), w as (select * from v union all select score_id, 0, {DEFAULT.default_tempo}::double from v group by score_id having min(time) > 0),
  x as (select *, lag(tempo) over (partition by score_id order by time) p from w) select score_id, time, tempo from x where p is null or p <> tempo""")
def tempo_quantize(spark, sf):
    return preprocess.quantize_tempos(score.tempos(base.raw(spark, sf)), base.tpq(spark, sf))


def _bend_case() -> str:
    b = DEFAULT.pitch_bends
    return "case " + " ".join(f"when v * 2 < {x + y} then {x}" for x, y in zip(b, b[1:])) + f" else {b[-1]} end"


@query(f"""with {RAW}, b as (select score_id, track_idx, ord, round_even(tick * 8 / tpq, 0)::bigint as time, value - 8192 as v from ev join sc using (score_id) where event_type = 'PitchBend' and tick is not null and value is not null),
  c as (select score_id, track_idx, ord, time, ({_bend_case()})::bigint as value from b), d as (select *, row_number() over (partition by score_id, track_idx, time order by abs(value) desc, ord) n from c)
  select score_id, track_idx, time, value from d where n = 1""")
def pitch_bend_dedup(spark, sf):
    return preprocess.quantize_bends(score.pitch_bends(base.raw(spark, sf)), base.tpq(spark, sf))


@query(f"""with {PEDALS}, a as (select *, max(time + duration) over (partition by score_id, track_idx order by time, duration rows between unbounded preceding and 1 preceding) r from pd),
  b as (select *, sum(case when r >= time then 0 else 1 end) over (partition by score_id, track_idx order by time, duration rows unbounded preceding) g from a)
  select score_id, track_idx, min(time) as time, (max(time + duration) - min(time))::bigint as duration from b group by score_id, track_idx, g""")
def pedal_merge(spark, sf):
    return preprocess.merge_pedals(score.pedals(base.raw(spark, sf)))


@query(f"with {GRID} select score_id, track_idx, program, is_drum, name from tr where not exists (select 1 from gr where gr.score_id = tr.score_id and gr.track_idx = tr.track_idx)")
def empty_tracks(spark, sf):
    return preprocess.empty_tracks(base.tracks(spark, sf), base.grid_notes(spark, sf))


# grids

_TICKS = """ends as (select score_id, max(n.time) max_tick from nt n group by score_id),
sec as (select t.score_id, t.time, num, den, tpq, max_tick, lead(t.time) over (partition by t.score_id order by t.time) nx from tsn t join sc using (score_id) join ends using (score_id)),
bar_t as (select score_id, unnest(generate_series(time, least(coalesce(nx, max_tick + 1), max_tick + 1) - 1, (tpq * 4 // den) * num)) tick, num, den, (tpq * 4 // den) * num step from sec where least(coalesce(nx, max_tick + 1), max_tick + 1) > time),
bars as (select score_id, row_number() over (partition by score_id order by tick) - 1 as bar, tick, num, den, step from bar_t)"""
_BARS = f"{NOTES}, {SIGNATURES}, {_TICKS}"


def _grid(spark, sf):
    return base.signatures(spark, sf, True), base.tpq(spark, sf), grid.last_onset(base.notes(spark, sf))


@query(f"with {_BARS} select score_id, max_tick from ends")
def max_onset(spark, sf):
    return grid.last_onset(base.notes(spark, sf))


@query(f"with {_BARS} select score_id, bar, tick, num, den from bars")
def bars_ticks(spark, sf):
    return grid.bars(*_grid(spark, sf))


@query(f"""with {_BARS}, b as (select score_id, unnest(generate_series(time, least(coalesce(nx, max_tick), max_tick) - 1, tpq * 4 // den)) tick from sec where least(coalesce(nx, max_tick), max_tick) > time)
  select score_id, row_number() over (partition by score_id order by tick) - 1 as beat, tick from b""")
def beats_ticks(spark, sf):
    return grid.beats(*_grid(spark, sf))


@query(f"""with {_BARS}, w as (select *, lead(tick) over (partition by score_id order by tick) nx from bars)
  select w.score_id, bar, count(n.time) as n_notes from w left join nt n on n.score_id = w.score_id and n.time >= w.tick and (w.nx is null or n.time < w.nx) group by w.score_id, bar""")
def notes_per_bar(spark, sf):
    return grid.notes_per_bar(base.notes(spark, sf), grid.bars(*_grid(spark, sf)))


@query(f"""with {NOTES}, {SIGNATURES}, ends as (select score_id, max(n.time) - 1 max_tick from nt n group by score_id), {_TICKS.split('),', 1)[1]}
  select score_id, bar, tick as start_tick, coalesce(lead(tick) over (partition by score_id order by tick), tick + step)::bigint as end_tick from bars""")
def segment_bars(spark, sf):
    return grid.segment_bars(*_grid(spark, sf))


# grammars

def _span(x: str) -> str:
    """The value of a duration of x positions."""
    return f"(({x}) // 8) || '.' || case when ({x}) < 32 then (({x}) % 8) || '.8' else ((({x}) % 8) // 2) || '.4' end"


_TRIPLE = f"case when is_drum then 'PitchDrum_' else 'Pitch_' end || pitch, 'Velocity_' || velocity, 'Duration_' || {_span('duration')}"
_PREV = "*, lag(time) over (partition by score_id, track_idx order by nord) lt"


def _places(rows: str, order: str, key: str = "score_id, track_idx") -> str:
    return f"select {key}, row_number() over (partition by {key} order by {order}, k) as ord, token from (select {key}, {order}, unnest(tokens) token, generate_subscripts(tokens, 1) k from ({rows}))"


_REMI = f"""rm as ({_places(f"select score_id, track_idx, nord, list_concat(list_transform(range((time // 32 - coalesce(lt // 32, -1))::bigint), lambda i: 'Bar_None'), case when lt is null or lt <> time then ['Position_' || (time % 32)] else [] end, [{_TRIPLE}]) tokens from (select {_PREV} from grn)", "nord")})"""


@query(f"with {GRID}, {_REMI} select score_id, track_idx, ord, token from rm")
def remi_encode(spark, sf):
    return grammar.encode_remi(base.grid_notes(spark, sf))


def _vocab_values(name: str) -> str:
    rows = ", ".join(f"({i}, '{t}', {j})" for i, tokens in enumerate(vocabulary(name)) for j, t in enumerate(tokens))
    return f"(values {rows})"


@query(f"with {GRID}, {_REMI} select score_id, track_idx, ord, token, v.id::int as id from rm left join (select * from {_vocab_values('remi')} t(vocab_idx, token, id)) v using (token)")
def remi_ids(spark, sf):
    return grammar.token_ids(grammar.encode_remi(base.grid_notes(spark, sf)), grammar.vocabulary_rows(spark, "remi"))


_NOTES_OUT = "select score_id, track_idx, is_drum, time::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from gr"


@query(f"with {GRID} {_NOTES_OUT}")
def remi_decode(spark, sf):
    return grammar.decode_remi(grammar.encode_remi(base.grid_notes(spark, sf)))


def _greedy(x: str) -> str:
    small = f"(({x}) % 96)"
    return f"""list_transform(list_concat(list_transform(range(({x}) // 96), lambda i: 96), case when {small} > 32 and {small} % 2 = 1 then [{small} - 1, 1] when {small} > 0 then [{small}] else [] end), lambda s: 'TimeShift_' || {_span('s')})"""


_TSD = f"""tsd as ({_places(f"select score_id, track_idx, nord, list_concat({_greedy('time - coalesce(lt, 0)')}, [{_TRIPLE}]) tokens from (select {_PREV} from grn)", "nord")})"""


@query(f"with {GRID}, {_TSD} select score_id, track_idx, ord, token from tsd")
def tsd_encode(spark, sf):
    return grammar.encode_tsd(base.grid_notes(spark, sf))


@query(f"with {GRID} {_NOTES_OUT}")
def tsd_decode(spark, sf):
    return grammar.decode_tsd(grammar.encode_tsd(base.grid_notes(spark, sf)))


@query(f"""with {GRID}, e as (select score_id, track_idx, nord, time as a, 0 off, [case when is_drum then 'DrumOn_' else 'NoteOn_' end || pitch, 'Velocity_' || velocity] t from grn union all
  select score_id, track_idx, nord, time + duration, 1, [case when is_drum then 'DrumOff_' else 'NoteOff_' end || pitch] from grn),
  f as (select *, a - lag(a, 1, 0) over (partition by score_id, track_idx order by a, nord, off) s from e)
  {_places(f"select score_id, track_idx, a, nord, off, list_concat({_greedy('s')}, t) tokens from f", "a, nord, off")}""")
def midilike_encode(spark, sf):
    return grammar.encode_midilike(base.grid_notes(spark, sf))


@query(f"""with {GRID}, o as (select *, row_number() over (partition by score_id, track_idx, is_drum, pitch order by time, nord) k from grn),
  f as (select score_id, track_idx, is_drum, pitch, time + duration as e, row_number() over (partition by score_id, track_idx, is_drum, pitch order by time + duration, nord) k from grn)
  select score_id, track_idx, is_drum, time::bigint as time, (e - time)::bigint as duration, pitch, velocity::bigint as velocity from o join f using (score_id, track_idx, is_drum, pitch, k)""")
def midilike_decode(spark, sf):
    return grammar.decode_midilike(grammar.encode_midilike(base.grid_notes(spark, sf)))


@query(f"""with {GRID}, p as (select *, time - coalesce(lag(time) over (partition by score_id, track_idx order by nord), 0) s from grn),
  q as (select *, case when s <= 32 then s when s >= 96 then 96 else s + s % 2 end n from p)
  {_places(f"select score_id, track_idx, nord, ['TimeShift_' || case when s = 0 then '0.0.1' else {_span('n')} end, {_TRIPLE}] tokens from q", "nord")}""")
def structured_encode(spark, sf):
    return grammar.encode_structured(base.grid_notes(spark, sf))


@query(f"""with {GRID}, p as (select *, time - coalesce(lag(time) over (partition by score_id, track_idx order by nord), 0) s from grn),
  q as (select *, sum(case when s <= 32 then s when s >= 96 then 96 else s + s % 2 end) over (partition by score_id, track_idx order by nord) onset from p)
  select score_id, track_idx, is_drum, onset::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from q""")
def structured_decode(spark, sf):
    return grammar.decode_tsd(grammar.encode_structured(base.grid_notes(spark, sf)))


@query(f"""with {GRID} select score_id, track_idx, nord as ord, case when is_drum then 'PitchDrum_' else 'Pitch_' end || pitch as pitch, 'Position_' || (time % 32) as position,
  'Bar_' || least(time // 32, 59) as bar, 'Velocity_' || velocity as velocity, 'Duration_' || {_span('duration')} as duration from grn""")
def octuple_encode(spark, sf):
    return grammar.encode_octuple(base.grid_notes(spark, sf))


@query(f"with {GRID} select score_id, track_idx, is_drum, (least(time // 32, 59) * 32 + time % 32)::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from gr")
def octuple_decode(spark, sf):
    return grammar.decode_octuple(grammar.encode_octuple(base.grid_notes(spark, sf)))


_WORDS = f"""list_concat(list_transform(range((time // 32 - coalesce(lt // 32, -1))::bigint), lambda i: 'Family_Metric Bar_None Ignore_None Ignore_None Ignore_None'),
  case when lt is null or lt <> time then ['Family_Metric Position_' || (time % 32) || ' Ignore_None Ignore_None Ignore_None'] else [] end, ['Family_Note Ignore_None ' || concat_ws(' ', {_TRIPLE})])"""


@query(f"""with {GRID}, w as ({_places(f"select score_id, track_idx, nord, {_WORDS} tokens from (select {_PREV} from grn)", "nord")})
  select score_id, track_idx, ord, s[1] as family, s[2] as position, s[3] as pitch, s[4] as velocity, s[5] as duration from (select *, string_split(token, ' ') s from w)""")
def cpword_encode(spark, sf):
    return grammar.encode_cpword(base.grid_notes(spark, sf))


@query(f"with {GRID} {_NOTES_OUT}")
def cpword_decode(spark, sf):
    return grammar.decode_cpword(grammar.encode_cpword(base.grid_notes(spark, sf)))


@query(f"""with {GRID}, o as (select *, row_number() over (partition by score_id order by time, track_idx, duration, pitch, velocity) n from gr),
  p as (select *, lag(time) over (partition by score_id order by n) lt, lag(track_idx) over (partition by score_id order by n) lk, 'BarPosEnc_' || least(time // 32, 59) b, 'PositionPosEnc_' || (time % 32) q from o),
  w as ({_places(f'''select score_id, n, list_concat(list_transform(range((coalesce(lt // 32, -1) + 1)::bigint, (time // 32 + 1)::bigint), lambda i: 'Bar_None BarPosEnc_' || least(i, 59) || ' PositionPosEnc_None - -'),
    case when lt is null or lt <> time then ['Position_' || (time % 32) || ' ' || b || ' ' || q || ' - -'] else [] end,
    case when lt is null or lt <> time or lk <> track_idx then ['Program_' || program || ' ' || b || ' ' || q || ' - -'] else [] end,
    [case when is_drum then 'PitchDrum_' else 'Pitch_' end || pitch || ' ' || b || ' ' || q || ' Velocity_' || velocity || ' Duration_' || {_span('duration')}]) tokens from p''', "n", "score_id")})
  select score_id, ord, s[1] as token, s[2] as bar, s[3] as position, nullif(s[4], '-') as velocity, nullif(s[5], '-') as duration from (select *, string_split(token, ' ') s from w)""")
def mumidi_encode(spark, sf):
    return grammar.encode_mumidi(base.grid_notes(spark, sf))


@query(f"with {GRID} select score_id, program, is_drum, (least(time // 32, 59) * 32 + time % 32)::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from gr")
def mumidi_decode(spark, sf):
    return grammar.decode_mumidi(grammar.encode_mumidi(base.grid_notes(spark, sf)))


@query(f"""with {GRID}, {_REMI}, p as (select score_id, track_idx, min(program) pr from gr group by score_id, track_idx),
  a as (select score_id, track_idx, ord, token from rm union all select score_id, track_idx, -2, 'Track_Start' from p union all select score_id, track_idx, -1, 'Program_' || pr from p union all select score_id, track_idx, 4611686018427387904, 'Track_End' from p)
  select score_id, row_number() over (partition by score_id order by track_idx, ord) as ord, track_idx, token from a""")
def mmm_encode(spark, sf):
    return grammar.encode_mmm(base.grid_notes(spark, sf))


@query(f"""with {NOTES}, a as (select score_id, track_idx, coalesce(t.is_drum, false) is_drum, round_even(n.time * 220 / s.tpq, 0)::bigint as time, greatest(1, round_even(n.duration * 220 / s.tpq, 0)::bigint) as duration, n.pitch, 4 * greatest(1, (n.velocity + 3) // 4) - 1 as velocity
  from nt n join sc s using (score_id) left join tr t using (score_id, track_idx)), b as (select *, round_even(time / 27.5::double, 0)::bigint c from a where (is_drum and pitch between 27 and 88) or (not is_drum and pitch between 21 and 109)),
  d as (select *, row_number() over w as o, lag(c) over w lc from b window w as (partition by score_id, track_idx order by c, time, duration, pitch, velocity))
  {_places(f'''select score_id, track_idx, o, list_concat(list_transform(range((c // 32 - coalesce(lc // 32, -1))::bigint), lambda i: 'Bar_None'), ['Position_' || (c % 32), 'MicroTiming_' || greatest(ceil((greatest(-55.0::double, least(55.0::double, time - c * 27.5::double)) + 55.0::double) / {110 / 109!r}::double - 0.5::double), 0)::bigint,
    case when is_drum then 'PitchDrum_' else 'Pitch_' end || pitch, 'Velocity_' || velocity, 'Duration_' || duration]) tokens from d''', "o")}""")
def pertok_encode(spark, sf):
    fine = DEFAULT.__class__(beat_res=((0, 4, 220),))
    d = base.notes(spark, sf).join(base.tracks(spark, sf).select("score_id", "track_idx", "program", "is_drum"), ["score_id", "track_idx"], "left").withColumn("is_drum", F.coalesce("is_drum", F.lit(False)))
    d = preprocess.quantize_velocity(preprocess.resample(preprocess.in_pitch_range(d), base.tpq(spark, sf), fine))
    return grammar.encode_pertok(d)


def _vocabulary_query(name: str):
    def f(spark, sf):
        return grammar.vocabulary_rows(spark, name)

    f.__name__ = f"vocab_{name}"
    query(f"select vocab_idx::int as vocab_idx, token, id::int as id from {_vocab_values(name)} t(vocab_idx, token, id)")(f)


for _name in ("remi", "tsd", "midilike", "structured", "octuple", "cpword", "mumidi", "mmm"):
    _vocabulary_query(_name)


@query("select split_part(token, '_', 1) as type, count(*) as n_ids, min(id) as first_id, max(id) as last_id from vocab group by 1")
def token_type_index(spark, sf):
    v = base.table(spark, sf, "vocab")
    return v.groupBy(F.split("token", "_")[0].alias("type")).agg(F.count("*").alias("n_ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_EDGES = ", ".join(f"'{a}>{b}'" for a, b in type_graph("remi"))
_ERRORS = f"""a as (select *, split_part(token, '_', 1) t, split_part(token, '_', 2) v from src),
  b as (select *, lag(t) over w lt, sum(case when t = 'Bar' then 1 else 0 end) over w br, sum(case when t in ('Bar', 'Position', 'TimeShift') then 1 else 0 end) over w onset, case when t = 'Position' then v::int end ps from a window w as (partition by score_id, seq order by ord)),
  c as (select *, ps <= max(ps) over (partition by score_id, seq, br order by ord rows between unbounded preceding and 1 preceding) back, row_number() over (partition by score_id, seq, onset, token order by ord) rn from b)
  select score_id, seq, count(*) as n_tokens, sum(case when lt is not null and (lt || '>' || t) not in ({_EDGES}) then 1 else 0 end)::bigint as n_type_errors,
  sum(case when back then 1 else 0 end)::bigint as n_time_errors, sum(case when t in ('Pitch', 'PitchDrum') and rn > 1 then 1 else 0 end)::bigint as n_note_errors from c group by score_id, seq"""


@query(f"with {GRID}, {_REMI}, src as (select score_id, track_idx seq, ord, token from rm), {_ERRORS}".replace("select score_id, seq, count", "select score_id, seq as track_idx, count"))
def remi_errors(spark, sf):
    return grammar.token_errors(grammar.encode_remi(base.grid_notes(spark, sf)), type_graph("remi"))


_UNI = " union all ".join(f"select '{g}' grammar, token from {_vocab_values(g)} t(vocab_idx, token, id)" for g in ("remi", "tsd", "midilike"))


@query(f"""with v as ({_UNI}), o as (select token, count(distinct grammar) = 3 shared, case when count(distinct grammar) = 3 then '' else min(grammar) end g, 0 mark from v group by token union all
  select distinct '<' || grammar || '>', false, grammar, 1 from v) select token, row_number() over (order by mark, g, token) - 1 as id, shared from o""")
def universal_vocab(spark, sf):
    names = ("remi", "tsd", "midilike")
    rows = [(g, t) for g in names for t in vocabulary(g)[0]]
    return grammar.universal_vocabulary(spark.createDataFrame(rows, "grammar string, token string"), len(names))


@query(f"""with {GRID}, p as (select score_id, track_idx, nord, time - coalesce(lag(time) over (partition by score_id, track_idx order by nord), 0) s from grn)
  select score_id, track_idx, nord as ord, (s // 96 + case when s % 96 > 32 and s % 96 % 2 = 1 then 2 when s % 96 > 0 then 1 else 0 end)::bigint as n_shifts from p""")
def greedy_timeshift(spark, sf):
    d = preprocess.numbered(base.grid_notes(spark, sf))
    last = F.lag("time", 1, 0).over(grammar.Window.partitionBy("score_id", "track_idx").orderBy("ord"))
    return d.select("score_id", "track_idx", "ord", F.size(greedy(F.col("time") - last, [n for n, _ in DEFAULT.durations])).cast("bigint").alias("n_shifts"))
