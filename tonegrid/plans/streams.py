"""Queries of whole scores on their grid and of sequences with all kinds of tokens, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT
from tonegrid.operators import harmony, pipeline, score, stream
from tonegrid.operators.pipeline import Switches
from tonegrid.plans import base, music
from tonegrid.plans.base import RAW, _pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepared(spark: SparkSession, sf_dir: str, switches: Switches) -> pipeline.Prepared:
    raw = base.raw(spark, sf_dir)
    return pipeline.prepare(
        base.notes(spark, sf_dir), base.tpq(spark, sf_dir), base.tracks(spark, sf_dir), score.time_signatures(raw), score.tempos(raw), score.pedals(raw), score.pitch_bends(raw), switches
    )


_SUPPORTED = ", ".join(map(str, DEFAULT.time_signatures))


def tables_sql(w: Switches) -> str:
    """The tables of pipeline.prepare(): nn (notes), te, pp, pb, tsn and sec (sections)."""
    ts = base.SIGNATURES.split("ts_o as", 1)[1].replace("join sc s using", "join sg s using").replace("(select distinct score_id, tpq from ts_o)", "(select score_id, tpq from sg)")
    own = f"select distinct score_id, tick, numerator num, denominator den from raw_events where event_type = 'TimeSignature' and tick is not null and (numerator, denominator) in ({_SUPPORTED})" + ("" if w.signatures else " and false")
    lasting = """case when ({x}) < 33 then least(32, greatest(1, floor(({x}) + 0.5))) else least(96, floor(({x}) / 2 + 0.5) * 2) end * f"""
    program = "case when coalesce(t.is_drum, false) then -1 else coalesce(t.program, 0) end"
    first = f"min(t.track_idx) over (partition by t.score_id, {program})" if w.one_stream else "t.track_idx"
    kinds = f"kd as (select score_id, track_idx, coalesce(t.is_drum, false) is_drum, {program} program, {first} first_idx from tr t)"

    def rounded(name: str, source: str, columns: str) -> str:
        """Rows of source with time on the grid, and f, the step of their section then."""
        return f"""{name}_1 as (select x.* exclude (time), {columns} sg.tpq, sg.old, round_even(x.time * sg.tpq / sg.old, 0)::bigint g from {source} x join sg using (score_id)),
{name}_2 as (select a.* exclude (g), (round_even(a.g / s.f::double, 0) * s.f)::bigint as time from {name}_1 a asof left join sec s on a.score_id = s.score_id and a.g >= s.t0),
{name}_3 as (select a.*, s.f from {name}_2 a asof left join sec s on a.score_id = s.score_id and a.time >= s.t0)"""

    def by_ends(name: str) -> str:
        return f"""{name}_4 as (select *, (greatest(1, round_even(greatest(1, round_even(duration * tpq / old, 0)) / f::double, 0)) * f)::bigint d from {name}_3),
{name}_5 as (select a.*, s.f fe, (round_even((time + d) / s.f::double, 0) * s.f)::bigint e from (select *, time + d as till from {name}_4) a asof left join sec s on a.score_id = s.score_id and a.till >= s.t0),
{name}_6 as (select * exclude (duration), case when fe = f then d else greatest(fe, e - time) end::bigint as duration from {name}_5)"""

    t = f"""{RAW},
note_ev as (select score_id, track_idx, channel, pitch, ord, tick, coalesce(velocity, 0) velocity, event_type from ev where event_type in ('NoteOn', 'NoteOff') and ord is not null and tick is not null and pitch is not null),
{_pairs("note_ev", "nt", "event_type = 'NoteOn' and velocity > 0")},
pedal_ev as (select score_id, track_idx, channel, 0 as pitch, ord, tick, 1 as velocity, value from ev where event_type = 'ControlChange' and controller = 64 and value is not null and tick is not null and ord is not null),
{_pairs("pedal_ev", "pd", "value >= 64")},
ts_own as ({own}),
sg as (select score_id, any_value(sc.tpq) as old, (8 * greatest(4, coalesce(max(den), 4)) // 4)::int tpq from sc left join ts_own using (score_id) group by score_id),
ts_raw as (select distinct score_id, (tick * sg.tpq // sg.old) as time, num, den from ts_own join sg using (score_id)),
ts_o as{ts},
sec_1 as (select score_id, time t0, num, den, tpq, greatest(1, tpq * 4 // den // 8) f, (tpq * 4 // den) * num long, lead(time) over (partition by score_id order by time) nx from tsn join sg using (score_id)),
sec as (select score_id, t0, num, den, f, long, coalesce(sum((nx - t0) // long) over (partition by score_id order by t0 rows between unbounded preceding and 1 preceding), 0)::bigint bar0 from sec_1),
{kinds},
nk as (select n.score_id, coalesce(k.first_idx, n.track_idx) track_idx, coalesce(k.program, 0) program, coalesce(k.is_drum, false) is_drum, n.time, n.duration, n.pitch, 4 * greatest(1, (n.velocity + 3) // 4) - 1 as velocity
  from nt n left join kd k using (score_id, track_idx) where case when coalesce(k.is_drum, false) then n.pitch between 27 and 88 else n.pitch between 21 and 109 end),
{rounded("nq", "nk", "")}"""
    if w.note_offs:
        t += f",\n{by_ends('nq')},\nnn as (select score_id, track_idx, program, is_drum, time, duration, pitch, velocity, f from nq_6)"
    else:
        t += f",\nnn as (select * exclude (duration, tpq, old), ({lasting.format(x='greatest(1, round_even(duration * tpq / old, 0)) / f::double')})::bigint as duration from nq_3)"
    if w.tempos:
        t += f""",\ntq as (select distinct score_id, tick as time, usec_per_quarter usec, tick as t from raw_events where event_type = 'Tempo' and tick is not null and usec_per_quarter > 0),
{rounded("tq", "tq", "")}, tl as (select score_id, time, usec from (select *, row_number() over (partition by score_id, time order by usec desc) n from tq_3) where n = 1),
tv as (select score_id, time, ({music._tempo_case()})::double as tempo from tl), tw as (select * from tv union all select score_id, 0, {DEFAULT.default_tempo}::double from tv group by score_id having min(time) > 0),
te as (select score_id, time, tempo from (select *, lag(tempo) over (partition by score_id order by time) p from tw) where p is null or p <> tempo)"""
    if w.pedals:
        t += f""",\npk as (select p.score_id, coalesce(k.first_idx, p.track_idx) track_idx, p.time, p.duration from pd p left join kd k using (score_id, track_idx)),
{rounded("pq", "pk", "")},\n{by_ends("pq")},
pa as (select *, max(time + duration) over (partition by score_id, track_idx order by time, duration rows between unbounded preceding and 1 preceding) r from pq_6),
pz as (select *, sum(case when r >= time then 0 else 1 end) over (partition by score_id, track_idx order by time, duration rows unbounded preceding) z from pa),
pm as (select score_id, track_idx, min(time) as time, (max(time + duration) - min(time))::bigint as d from pz group by score_id, track_idx, z),
pp as (select score_id, track_idx, time, f, {f"({lasting.format(x='d / f::double')})::bigint" if w.pedal_durations else "d"} as duration from pm a asof left join sec s on a.score_id = s.score_id and a.time >= s.t0)"""
        t = t.replace("select score_id, track_idx, time, f, ", "select a.score_id, track_idx, time, f, ")
    if w.bends:
        t += f""",\nbk as (select e.score_id, coalesce(k.first_idx, e.track_idx) track_idx, e.ord, e.tick as time, e.value - 8192 as v from ev e left join kd k using (score_id, track_idx) where event_type = 'PitchBend' and tick is not null and value is not null),
{rounded("bq", "bk", "")}, bv as (select score_id, track_idx, ord, time, ({music._bend_case()})::bigint as value from bq_3),
pb as (select score_id, track_idx, time, value from (select *, row_number() over (partition by score_id, track_idx, time order by abs(value) desc, ord) n from bv) where n = 1)"""
    return t


_REST = "case when n < 8 then '0.' || n || '.8' when n < 16 then (n // 8) || '.' || (n % 8 // 2) || '.4' else (n // 8) || '.' || (n % 8 // 4) || '.2' end"
_CHORD = "case k " + " ".join(f"when '{','.join(map(str, s))}' then '{n}'" for n, s in harmony.CHORDS.items()) + " end"
_ORDER = "time, rank, whole, track_idx, part, k0, k1, k2, k3, sub"


def _span(x: str) -> str:
    return f"((({x}) // 8) || '.' || case when ({x}) < 32 then (({x}) % 8) || '.8' else ((({x}) % 8) // 2) || '.4' end)"


def items_sql(w: Switches) -> str:
    """The table it of stream.items(), and rw: each item with what comes before it, where it stands and its rests."""
    own = "['Program_' || program]" if w.programs and not w.program_changes else "[]::varchar[]"
    on, drum = ("NoteOn_", "DrumOn_") if w.note_offs else ("Pitch_", "PitchDrum_")
    first = f"case when is_drum then '{drum}' else '{on}' end || pitch"
    notes = "nn"
    cte = ""
    ranked = w.chords and w.note_offs
    rank = lambda n: n if ranked else 0
    if w.intervals:
        cte = """, i1 as (select *, lag(time) over v lt, lag(pitch) over v lp from nn window v as (partition by score_id, track_idx order by time, duration, pitch, velocity)),
i2 as (select *, last_value(case when lt is null or lt <> time or abs(pitch - lp) > 16 then pitch end ignore nulls) over (partition by score_id, track_idx order by time, duration, pitch, velocity rows between unbounded preceding and 1 preceding) o from i1)"""
        notes = "i2"
        first = f"case when is_drum then 'PitchDrum_' || pitch when (lt is null or lt <> time) and time - lt <= 8 * f and abs(pitch - o) <= 16 then 'PitchIntervalTime_' || (pitch - o) when lt = time and abs(pitch - lp) <= 16 then 'PitchIntervalChord_' || (pitch - lp) else '{on}' || pitch end"
    length = "" if w.note_offs else f", 'Duration_' || {_span('(duration // f)')}"
    keys = "time k0, duration k1, pitch k2, velocity k3"
    rows = [f"select score_id, track_idx, time, {rank(10)} as rank, 1 whole, 3 part, {keys}, 0 sub, 'Note' kind, list_concat({own}, [{first}, 'Velocity_' || velocity{length}]) tokens, program, time + duration reach from {notes}"]
    if w.note_offs:
        rows.append(f"select score_id, track_idx, time + duration, {rank(1)}, 1, 3, {keys}, 1, 'Off', list_concat({own}, [case when is_drum then 'DrumOff_' else 'NoteOff_' end || pitch]), program, 0 from nn")
    cte += ", pg as (select distinct score_id, track_idx, program, is_drum from nn)"
    if w.pedals:
        name = "program" if w.programs else "0"
        held = f", 'Duration_' || {_span('(duration // f)')}" if w.pedal_durations else ""
        rows.append(f"select p.score_id, p.track_idx, time, {rank(2)}, 1, 0, time, 0, 0, 0, 0, 'Pedal', ['Pedal_' || {name}{held}], program, time from pp p join pg using (score_id, track_idx)")
        if not w.pedal_durations:
            rows.append(f"select p.score_id, p.track_idx, time + duration, {rank(2)}, 1, 0, time, 0, 0, 0, 1, 'Pedal', ['PedalOff_' || {name}], program, time + duration from pp p join pg using (score_id, track_idx)")
    if w.bends:
        rows.append(f"select b.score_id, b.track_idx, time, {rank(3)}, 1, 1, time, 0, 0, 0, 0, 'PitchBend', list_concat({own}, ['PitchBend_' || value]), program, time from pb b join pg using (score_id, track_idx)")
    if w.chords:
        cte += f""", h1 as (select score_id, track_idx, time, list_sort(list({{'pitch': pitch, 'e': time + duration}}))[1:10] n from nn where not is_drum group by score_id, track_idx, time),
h2 as (select *, array_to_string(list_transform(n, lambda x: x.pitch - n[1].pitch), ',') k from h1 where len(n) between 3 and 5 and len(list_filter(n, lambda x: abs(x.e - n[1].e) > 4)) = 0 and n[-1].pitch - n[1].pitch <= 24),
hc as (select score_id, track_idx, time, {_CHORD} chord from h2)"""
        rows.append(f"select c.score_id, c.track_idx, time, {rank(10)}, 1, 2, time, 0, 0, 0, 0, 'Chord', list_concat({own}, ['Chord_' || chord]), program, time from hc c join pg using (score_id, track_idx) where chord is not null")
    who = "(select distinct score_id, -1 as track_idx from pg)" if w.one_stream else "(select score_id, track_idx from pg)"
    if w.signatures:
        rows.append(f"select t.score_id, q.track_idx, time, 0, 0, 0, 0, 0, 0, 0, 0, 'TimeSig', ['TimeSig_' || num || '/' || den], null, {'0' if w.note_offs else 'time'} from tsn t join {who} q using (score_id)")
    if w.tempos:
        rows.append(f"select t.score_id, q.track_idx, time, 0, 0, 1, 0, 0, 0, 0, 0, 'Tempo', ['Tempo_' || regexp_replace(printf('%.2f', tempo), '(\\.\\d)0$', '\\1')], null, time from te t join {who} q using (score_id)")
    key = "score_id" if w.one_stream else "score_id, track_idx"
    over = f"(partition by {key} order by {_ORDER}"
    changes = f"case when kind in ('Note', 'Off', 'PitchBend', 'Chord') and (pr is null or pr <> program) then ['Program_' || program] else [] end" if w.program_changes and w.one_stream else "[]::varchar[]"
    head = "case when nr = 1 then ['Program_' || p0] else [] end" if w.program_changes and not w.one_stream else "[]::varchar[]"
    small = "(quiet % 96)"
    rests = f"list_concat(list_transform(range(quiet // 96), lambda i: 96), case when {small} >= 16 and {small} % 4 > 0 then [{small} - {small} % 4, {small} % 4] when {small} between 8 and 15 and {small} % 2 > 0 then [{small} - {small} % 2, {small} % 2] when {small} > 0 then [{small}] else [] end)"
    silent = f"case when apart and quiet >= 1 then {rests} else []::bigint[] end" if w.rests else "[]::bigint[]"
    return f"""{cte}, it as ({' union all '.join(rows)}),
a1 as (select *, lag(time) over {over}) last, lag(kind) over {over}) last_kind, greatest(0, coalesce(max(reach) over {over} rows between unbounded preceding and 1 preceding), 0)) reached, row_number() over {over}) nr, min(program) over (partition by {key}) p0,
  last_value(case when kind in ('Note', 'Off', 'PitchBend', 'Chord') then program end ignore nulls) over {over} rows between unbounded preceding and 1 preceding) pr, case when kind = 'TimeSig' then greatest(0, time - 1) else time end bt from it),
a2 as (select a.*, s.f, s.num, s.den, s.bar0 + (a.time - s.t0) // s.long bar, s.t0 + (a.time - s.t0) // s.long * s.long bar_tick from a1 a asof left join sec s on a.score_id = s.score_id and a.time >= s.t0),
a3 as (select a.*, s.f bf, s.num bnum, s.den bden, (a.time - reached) // s.f quiet, last is null or last <> time {'or last_kind = ' + "'TimeSig'" if not w.note_offs else ''} apart from a2 a asof left join sec s on a.score_id = s.score_id and a.bt >= s.t0),
a4 as (select *, {silent} rs, {changes} changed, {head} head from a3),
a5 as (select *, list_transform(rs, lambda n: 'Rest_' || {_REST}) rest_tokens, case when len(rs) > 0 then reached + list_sum(rs)::bigint * bf else last end elapsed, greatest(case when last is null then -1 else lag(bar) over (partition by {key} order by nr) end, -1) lb from a4),
rw as (select a.*, greatest(lb, case when len(rs) > 0 then s.bar0 + (a.el - s.t0) // s.long else -1 end) known from (select *, coalesce(elapsed, 0) el from a5) a asof left join sec s on a.score_id = s.score_id and a.el >= s.t0)"""


def _placed(w: Switches, tokens: str) -> str:
    key = "score_id" if w.one_stream else "score_id, track_idx"
    track = "" if w.one_stream else "track_idx, "
    return f"""select score_id, {track}row_number() over (partition by {key} order by nr, i) as ord, token from (
  select score_id, track_idx, nr, unnest(tk) token, generate_subscripts(tk, 1) i from (select *, {tokens} tk from rw))"""


def _all(w: Switches) -> str:
    return f"with {tables_sql(w)}{items_sql(w)}"


def remi_sql(w: Switches) -> str:
    sign = lambda n, d: f"'TimeSig_' || {n} || '/' || {d}"
    end = "case when b > 0 then ['Bar_End'] else [] end" if w.bar_ends else "[]::varchar[]"
    bar = f"list_concat({end}, case when kind = 'TimeSig' and b = bar then ['Bar_None'] when kind = 'TimeSig' then ['Bar_None', {sign('bnum', 'bden')}] else ['Bar_None', {sign('num', 'den')}] end)" if w.signatures else f"list_concat({end}, ['Bar_None'])"
    bars = f"flatten(list_transform(range(known + 1, bar + 1), lambda b: {bar}))"
    position = "case when apart and kind <> 'TimeSig' then ['Position_' || ((time - bar_tick) // f)] else [] end"
    return f"{_all(w)} {_placed(w, f'list_concat(head, rest_tokens, {bars}, {position}, changed, tokens)')}"


def tsd_sql(w: Switches) -> str:
    sql = _all(w).replace("or last_kind = 'TimeSig' apart", "apart")
    left = "((time - coalesce(elapsed, 0)) // bf)"
    return f"{sql} {_placed(w, f'list_concat(head, rest_tokens, {music._greedy(left)}, changed, tokens)')}"


def octuple_sql(w: Switches) -> str:
    key = "score_id" if w.one_stream else "score_id, track_idx"
    tempo = f"coalesce(last_value(case when kind = 'Tempo' then tokens[1] end ignore nulls) over (partition by {key} order by nr rows unbounded preceding), 'Tempo_{DEFAULT.default_tempo}')" if w.tempos else "null::varchar"
    return f"""{_all(w)}, o as (select *, {tempo} tm from rw) select {key}, row_number() over (partition by {key} order by nr) as ord, tokens[-3] as pitch, 'Position_' || ((time - bar_tick) // f) as position, 'Bar_' || least(bar, 59) as bar,
  tokens[-2] as velocity, tokens[-1] as duration, {"'Program_' || program" if w.programs else 'null::varchar'} as program, tm as tempo, {"'TimeSig_' || num || '/' || den" if w.signatures else 'null::varchar'} as signature from o where kind = 'Note'"""


def cpword_sql(w: Switches) -> str:
    key = "score_id" if w.one_stream else "score_id, track_idx"
    tempo = f"coalesce(last_value(case when kind = 'Tempo' then tokens[1] end ignore nulls) over (partition by {key} order by nr rows unbounded preceding), 'Tempo_{DEFAULT.default_tempo}')" if w.tempos else "'Ignore_None'"
    word = lambda **p: " || ' ' || ".join(p.get(c, "'Family_Metric'" if c == "family" else "'Ignore_None'") for c in stream.WORD)
    sign = "case when kind = 'TimeSig' and b < bar then 'TimeSig_' || bnum || '/' || bden else 'TimeSig_' || num || '/' || den end" if w.signatures else "'Ignore_None'"
    none = "'Bar_None'"
    bars = f"list_transform(range(known + 1, bar + 1), lambda b: {word(position=none, signature=sign)})"
    place = "'Position_' || ((time - bar_tick) // f)"
    chord = "case when kind = 'Chord' then tokens[-1] else 'Ignore_None' end"
    position = f"case when apart and kind <> 'TimeSig' then [{word(position=place, chord=chord, tempo='tm')}] else [] end"
    family, program = "'Family_Note'", "'Program_' || program" if w.programs else "'Ignore_None'"
    note = f"case when kind = 'Note' then [{word(family=family, pitch='tokens[-3]', velocity='tokens[-2]', duration='tokens[-1]', program=program)}] else [] end"
    rests = f"list_transform(rest_tokens, lambda r: {word(rest='r')})"
    placed = _placed(w, f"list_concat({rests}, {bars}, {position}, {note})").replace("from rw)", f"from (select *, {tempo} tm from rw))")
    parts = ", ".join(f"p[{i}] as {c}" for i, c in enumerate(stream.WORD, 1))
    return f"{_all(w)}, cw as ({placed}) select {key}, ord, {parts} from (select *, string_split(token, ' ') p from cw)"


_WHOLE = {"signatures": True, "tempos": True, "rests": True, "pedals": True, "bends": True}
FORMS: dict[str, tuple[Callable, Callable, Switches]] = {
    "remi_whole": (stream.encode_remi, remi_sql, Switches(**_WHOLE, chords=True, bar_ends=True)),
    "remi_one_stream": (stream.encode_remi, remi_sql, Switches(**_WHOLE, programs=True, one_stream=True, pedal_durations=True)),
    "tsd_whole": (stream.encode_tsd, tsd_sql, Switches(**_WHOLE, intervals=True, programs=True, program_changes=True)),
    "tsd_one_stream": (stream.encode_tsd, tsd_sql, Switches(**_WHOLE, chords=True, programs=True, one_stream=True, program_changes=True)),
    "midilike_whole": (stream.encode_tsd, tsd_sql, Switches(**_WHOLE, chords=True, note_offs=True)),
    "octuple_whole": (stream.encode_octuple, octuple_sql, Switches(signatures=True, tempos=True, programs=True, one_stream=True)),
    "cpword_whole": (stream.encode_cpword, cpword_sql, Switches(signatures=True, tempos=True, rests=True, chords=True, programs=True, one_stream=True)),
}


def _form(name: str):
    encode, sql, switches = FORMS[name]

    def f(spark, sf):
        return encode(prepared(spark, sf, switches), switches)

    f.__name__ = name
    QUERIES[name], SQL[name] = f, sql(switches)


for _name in FORMS:
    _form(_name)


_PREPARED = Switches(**_WHOLE, programs=True, one_stream=True, pedal_durations=True)


def score_preprocess(spark, sf):
    """Notes, tempos, signatures, pedals and bends of whole scores on their grids, as rows of one table."""
    p = prepared(spark, sf, _PREPARED)
    null = lambda n: [F.lit(None).cast("bigint")] * n
    rows = lambda d, kind, *c: d.select("score_id", F.lit(kind).alias("kind"), *[(F.col(x) if isinstance(x, str) else x).cast("bigint") for x in c]).toDF("score_id", "kind", "track_idx", "time", "a", "b", "c")
    d = rows(p.notes, "note", "track_idx", "time", "duration", "pitch", "velocity").union(rows(p.pedals, "pedal", "track_idx", "time", "duration", *null(2)))
    d = d.union(rows(p.bends, "bend", "track_idx", "time", "value", *null(2))).union(rows(p.signatures, "signature", *null(1), "time", "num", "den", *null(1)))
    return d.union(rows(p.tempos, "tempo", *null(1), "time", F.rint(F.col("tempo") * 100), *null(2)))


QUERIES["score_preprocess"] = score_preprocess
SQL["score_preprocess"] = f"""with {tables_sql(_PREPARED)} select score_id, 'note' as kind, track_idx::bigint as track_idx, time, duration as a, pitch::bigint as b, velocity::bigint as c from nn
union all select score_id, 'pedal', track_idx, time, duration, null, null from pp union all select score_id, 'bend', track_idx, time, value, null, null from pb
union all select score_id, 'signature', null, time, num, den, null from tsn union all select score_id, 'tempo', null, time, round(tempo * 100)::bigint, null, null from te"""


_MU = Switches(tempos=True, programs=True, one_stream=True)


def mumidi_whole(spark, sf):
    """MuMIDI with tempos."""
    return stream.encode_mumidi(prepared(spark, sf, _MU))


QUERIES["mumidi_whole"] = mumidi_whole
SQL["mumidi_whole"] = f"""{_all(_MU)}, m1 as (select *, coalesce(last_value(case when kind = 'Tempo' then tokens[1] end ignore nulls) over (partition by score_id order by nr rows unbounded preceding), 'Tempo_{DEFAULT.default_tempo}') tm from rw),
m2 as (select *, row_number() over (partition by score_id order by time, program, track_idx, k1, k2, k3) n from m1 where kind = 'Note'),
m3 as (select *, lag(time) over (partition by score_id order by n) lt, lag(program) over (partition by score_id order by n) lp, 'BarPosEnc_' || least(time // 32, 59) b, 'PositionPosEnc_' || (time % 32) q from m2),
m4 as ({music._places('''select score_id, n, list_concat(list_transform(range((coalesce(lt // 32, -1) + 1)::bigint, (time // 32 + 1)::bigint), lambda i: 'Bar_None BarPosEnc_' || least(i, 59) || ' PositionPosEnc_None ' || tm || ' - -'),
  case when lt is null or lt <> time then ['Position_' || (time % 32) || ' ' || b || ' ' || q || ' ' || tm || ' - -'] else [] end, case when lt is null or lt <> time or lp <> program then ['Program_' || program || ' ' || b || ' ' || q || ' ' || tm || ' - -'] else [] end,
  [tokens[-3] || ' ' || b || ' ' || q || ' ' || tm || ' ' || tokens[-2] || ' ' || tokens[-1]]) tokens from m3''', "n", "score_id")})
select score_id, ord, s[1] as token, s[2] as bar, s[3] as position, s[4] as tempo, nullif(s[5], '-') as velocity, nullif(s[6], '-') as duration from (select *, string_split(token, ' ') s from m4)"""
