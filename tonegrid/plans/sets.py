"""Queries of the operators on scores, bars, sequences and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT
from tonegrid.functions import uniform
from tonegrid.operators import collate, controls, corrupt, grammar, harmony, structure
from tonegrid.plans import base
from tonegrid.plans.base import GRID, RAW
from tonegrid.plans.music import _REMI
from tonegrid.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BAR = 32
SEQ = ["score_id", "seq_id"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_N = "time::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity"


@query(f"with {GRID} select score_id, row_number() over (partition by score_id order by time, track_idx, duration, pitch, velocity) as ord, track_idx, {_N} from gr")
def merge_tracks(spark, sf):
    return structure.merge_tracks(base.grid_notes(spark, sf))


@query(f"with {RAW} select score_id, coalesce(string_agg(name, ' / ' order by track_idx), '') as name from tr group by score_id")
def merge_track_names(spark, sf):
    return structure.merged_names(base.tracks(spark, sf))


@query(f"with {GRID} select score_id, min(track_idx) over (partition by score_id, program) as track_idx, program, is_drum, {_N} from gr")
def merge_same_program(spark, sf):
    return structure.merge_same_program(base.grid_notes(spark, sf))


@query(f"""with {GRID}, c as (select * exclude (program), case when program < 0 then 16 else program // 8 end::int as "class" from gr)
  select score_id, track_idx, "class", case when "class" = 16 then -1 else "class" * 8 end as program, is_drum, {_N} from c""")
def merge_per_class_all(spark, sf):
    """Every class of a score."""
    return structure.merge_per_class(base.grid_notes(spark, sf))


def _parts(spark, sf):
    return base.scores(spark, sf).select("score_id", F.floor(F.col("score_id") / 2).alias("new_id"), (F.col("score_id") % 2).alias("pos"))


@query(f"""with {GRID}, en as (select score_id, max(time + duration) e from gr group by score_id),
  sh as (select score_id, score_id // 2 as new_id, coalesce(sum(e) over (partition by score_id // 2 order by score_id % 2 rows between unbounded preceding and 1 preceding), 0) s from en)
  select score_id, new_id, track_idx, program, is_drum, (time + s)::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from gr join sh using (score_id)""")
def concat_scores(spark, sf):
    return structure.concat_scores(base.grid_notes(spark, sf), _parts(spark, sf))


@query(f"""with {GRID}, allsc as (select score_id, any_value(tpq) q from scores group by score_id), ok as (select score_id // 2 as new_id from allsc where q > 0 group by 1 having count(distinct q) = 1),
  t as (select score_id, track_idx, score_id // 2 as new_id from gr where score_id // 2 in (select new_id from ok) group by score_id, track_idx),
  u as (select *, (row_number() over (partition by new_id order by score_id % 2, track_idx) - 1)::int n from t)
  select new_id, u.n as track_idx, program, is_drum, {_N} from gr join u using (score_id, track_idx)""")
def merge_scores(spark, sf):
    return structure.merge_scores(base.grid_notes(spark, sf), _parts(spark, sf), base.tpq(spark, sf))


@query(f"with {GRID} select score_id, track_idx, program, is_drum, greatest(0, time - 32 - 16)::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity from gr where time >= 32 and time < 320")
def clip_shift(spark, sf):
    return structure.shift_time(structure.clip(base.grid_notes(spark, sf), 32, 320), -16)


_NT = "(time % {0})::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity"


@query(f"with {GRID} select score_id, track_idx, program, is_drum, time // 500 as piece, {_NT.format(500)} from gr")
def split_ticks(spark, sf):
    return structure.split_at(base.grid_notes(spark, sf), 500)


@query(f"""with {GRID}, e as (select score_id, max(time) t from gr group by score_id)
  select score_id, track_idx, program, is_drum, time // 128 as piece, {_NT.format(128)} from gr join e using (score_id) where not (time // 128 = t // 128 and t % 128 + 1 < 32)""")
def split_beats(spark, sf):
    return structure.split_at(base.grid_notes(spark, sf), 16 * DEFAULT.tpb, 4 * DEFAULT.tpb)


@query(f"with {GRID} select score_id || '-' || track_idx as score, program, is_drum, {_N} from gr")
def split_tracks(spark, sf):
    return base.grid_notes(spark, sf).select(F.concat_ws("-", "score_id", "track_idx").alias("score"), "program", "is_drum", "time", "duration", "pitch", "velocity")


@query(f"""with recursive {GRID}, bc as (select score_id, time // 32 as bar, 3 * count(*) n from gr group by all), al as (select score_id, unnest(generate_series(0, max(bar))) bar from bc group by score_id),
  cn as materialized (select al.score_id, al.bar, coalesce(n, 0)::bigint n, coalesce(lag(n) over (partition by al.score_id order by al.bar), 0)::bigint before from al left join bc using (score_id, bar)),
  rc as (select score_id, 0::bigint nxt, 0::bigint f, 0::bigint total, []::struct(f bigint, l bigint)[] done from (select distinct score_id from cn)
    union all
    select r.score_id, r.nxt + 1, case when not z.full then r.f when z.kept then r.nxt - 1 else r.nxt end, case when not z.full then r.total + c.n when z.kept then c.before + c.n else c.n end,
      case when z.full then list_append(r.done, {{'f': r.f, 'l': r.nxt - 1}}) else r.done end
    from rc r join cn c on c.score_id = r.score_id and c.bar = r.nxt, lateral (select r.nxt > r.f and r.total + c.n > 512 as full, c.before + c.n <= 512 and r.nxt - r.f > 1 as kept) z),
  fin as (select score_id, max_by(done, nxt) done, max_by(f, nxt) f, max_by(total, nxt) total, max(nxt) nxt from rc group by score_id),
  pc as (select score_id, case when total >= 128 then list_append(done, {{'f': f, 'l': nxt - 1}}) else done end p from fin)
  select score_id, (generate_subscripts(p, 1) - 1)::bigint as piece, unnest(p).f as first_bar, unnest(p).l as last_bar from pc""")
def split_density(spark, sf):
    return structure.split_by_density(_bar_counts(spark, sf), 512)


def _bar_counts(spark, sf) -> DataFrame:
    """Three tokens a note, of every bar of a score up to its last."""
    d = base.grid_notes(spark, sf).groupBy("score_id", F.floor(F.col("time") / BAR).alias("bar")).agg((3 * F.count("*")).alias("n"))
    last = d.groupBy("score_id").agg(F.max("bar").alias("last")).select("score_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("bar"))
    return last.join(d, ["score_id", "bar"], "left").select("score_id", "bar", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {GRID}, {_REMI}, a as (select score_id, track_idx, count(*) t from rm group by all), b as (select score_id, track_idx, count(*) n from gr group by all)
  select score_id, track_idx, a.t::double / b.n as tokens_per_note from a join b using (score_id, track_idx)""")
def tokens_per_note(spark, sf):
    n = base.grid_notes(spark, sf)
    t = grammar.encode_remi(n).groupBy("score_id", "track_idx").agg(F.count("*").alias("t"))
    return t.join(n.groupBy("score_id", "track_idx").agg(F.count("*").alias("n")), ["score_id", "track_idx"]).select("score_id", "track_idx", (F.col("t") / F.col("n")).alias("tokens_per_note"))


_SEQS = "sq as (select score_id, seq_id, any_value(ids) ids, any_value(len(ids))::bigint n from token_file where len(ids) > 0 group by score_id, seq_id)"
_POS = "ps as (select score_id, seq_id, n, generate_subscripts(ids, 1) - 1 as pos, unnest(ids) as id from sq)"


def _seqs(spark, sf) -> DataFrame:
    """Token sequences with ids, once per record."""
    from pyspark.sql import Window

    first = Window.partitionBy(*SEQ).orderBy("loaded_at")
    d = table(spark, sf, "token_file").where("size(ids) > 0").select(*SEQ, "ids", "loaded_at")
    return d.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*SEQ, "ids", F.size("ids").cast("bigint").alias("n"))


@query(f"with {_SEQS}, p as (select score_id, seq_id, n, unnest(generate_series(0, n - 17, 256)) first_pos from sq where n > 16) select score_id, seq_id, first_pos // 256 as piece, first_pos, (least(first_pos + 256, n) - 1)::bigint as last_pos from p")
def subsequences(spark, sf):
    return structure.subsequences(_seqs(spark, sf), SEQ, "n", 256, 16)


@query(f"with {_SEQS} select score_id, seq_id, sum(case when id = 4 then 1 else 0 end)::bigint as n_bars, sum(case when id between 10 and 41 and pos > coalesce(lb, -1) then 1 else 0 end)::bigint as n_positions from (select *, max(case when id = 4 then pos end) over (partition by score_id, seq_id) lb from (select score_id, seq_id, generate_subscripts(ids, 1) - 1 as pos, unnest(ids) as id from sq)) group by score_id, seq_id")
def num_bar_pos(spark, sf):
    last = F.size("ids") - F.array_position(F.reverse("ids"), 4).cast("int")
    after = F.when(F.array_contains("ids", 4), F.slice("ids", last + 2, F.size("ids"))).otherwise(F.col("ids"))
    return _seqs(spark, sf).select(*SEQ, F.size(F.filter("ids", lambda x: x == 4)).cast("bigint").alias("n_bars"), F.size(F.filter(after, lambda x: x.between(10, 41))).cast("bigint").alias("n_positions"))


@query(f"with {_SEQS}, {_POS}, b as (select *, sum(case when id = 4 then 1 else 0 end) over (partition by score_id, seq_id order by pos) bar from ps) select score_id, seq_id, bar::bigint as bar, min(pos) as first_pos, max(pos) as last_pos from b group by score_id, seq_id, bar")
def split_per_bars(spark, sf):
    d = corrupt.with_bars(corrupt.positions(_seqs(spark, sf), SEQ, "ids"), SEQ, 4)
    return d.groupBy(*SEQ, "bar").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


# segments


def _n_bars(spark, sf) -> DataFrame:
    return base.grid_notes(spark, sf).groupBy("score_id").agg((F.floor(F.max("time") / BAR) + 1).alias("n_bars"))


_NB = "nb as (select score_id, max(time) // 32 + 1 as n_bars from gr group by score_id)"


@query(f"with {GRID}, {_NB}, s as (select score_id, n_bars, unnest(generate_series(0, n_bars - 1, 8)) start_bar from nb) select score_id, start_bar, least(start_bar + 8, n_bars)::bigint as end_bar from s where least(start_bar + 8, n_bars) - start_bar >= 4")
def segments_fixed(spark, sf):
    return structure.fixed_segments(_n_bars(spark, sf), 8, 4)


@query(f"with {GRID}, {_NB}, s as (select score_id, unnest(generate_series(0, n_bars - 8, 4)) start_bar from nb where n_bars > 8) select score_id, start_bar, (start_bar + 8)::bigint as end_bar from s where start_bar % 8 <> 0")
def segments_sliding(spark, sf):
    return structure.sliding_segments(_n_bars(spark, sf), 8, 4)


def _u(seed: int, *columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 8))::bigint / 4294967296.0::double)"


@query(f"""with {GRID}, {_NB}, s as (select score_id, n_bars, unnest(generate_series(1, greatest(1, n_bars // 8))) i from nb where n_bars >= 2),
  t as (select *, 2 + floor({_u(1, 'score_id', 'i')} * (least(8, n_bars) - 2 + 1))::bigint l from s), v as (select score_id, floor({_u(2, 'score_id', 'i')} * (n_bars - l + 1))::bigint as start_bar, l from t)
  select score_id, start_bar, start_bar + l as end_bar from v""")
def segments_variable(spark, sf):
    return structure.variable_segments(_n_bars(spark, sf), 8, 2)


@query(f"""with {GRID}, {_NB}, s as (select score_id, n_bars, unnest(generate_series(0, n_bars - 1, 8)) start_bar from nb)
  select gr.score_id, track_idx, program, is_drum, start_bar, least(start_bar + 8, n_bars)::bigint as end_bar, (time - start_bar * 32)::bigint as time, duration::bigint as duration, pitch, velocity::bigint as velocity
  from gr join s on s.score_id = gr.score_id and time // 32 >= start_bar and time // 32 < start_bar + 8""")
def segment_notes(spark, sf):
    return structure.cut_segments(base.grid_notes(spark, sf), structure.fixed_segments(_n_bars(spark, sf), 8), BAR)


# augmentation

_OFFSETS = structure.offset_tuples([-2, 1, 2], [-4, 5], [-0.5, 1.0], True)
_OFFSET_ROWS = ", ".join(f"({p}, {v}, {int(d * 8)}, '#p{p}_v{v}_d{d:g}')" for p, v, d in _OFFSETS)


@query(f"""with {GRID}, lim as (select score_id, min(pitch) lo, max(pitch) hi from gr where not is_drum group by score_id), o as (select * from (values {_OFFSET_ROWS}) t(p, v, d, variant))
  select score_id, track_idx, variant, time::bigint as time, case when is_drum or d = 0 then duration when d > 0 then duration + d else greatest(1, duration + d) end::bigint as duration,
  case when is_drum then pitch else pitch + p end::int as pitch, case when v = 0 then velocity else greatest(1, least(127, velocity + v)) end::bigint as velocity
  from gr left join lim using (score_id), o where p = 0 or (coalesce(lo + p, 0) >= 0 and coalesce(hi + p, 0) <= 127)""")
def augment(spark, sf):
    return structure.augment(base.grid_notes(spark, sf), _OFFSETS, DEFAULT.tpb)


# attribute controls

_AC = f"""{GRID}, ab as (select *, time // 32 as bar from gr), an as (select score_id, track_idx, bar, count(*) n, max(bar) over (partition by score_id, track_idx) l from ab group by score_id, track_idx, bar),
ac as (select ab.* from ab join an using (score_id, track_idx, bar) where n > 1 or an.bar = l)"""


def _ac(spark, sf) -> DataFrame:
    return controls.bars_with_notes(base.grid_notes(spark, sf), BAR)


@query(f"with {_AC}, p as (select score_id, track_idx, bar, time, count(*) n from ac group by all) select score_id, track_idx, bar, greatest(1, least(6, min(n)))::bigint as min_polyphony, greatest(1, least(6, max(n)))::bigint as max_polyphony from p group by all")
def ac_bar_onset_polyphony(spark, sf):
    return controls.bar_onset_polyphony(_ac(spark, sf))


@query(f"with {_AC} select distinct score_id, track_idx, bar, pitch % 12 as pitch_class from ac")
def ac_bar_pitch_class(spark, sf):
    return controls.bar_pitch_classes(_ac(spark, sf))


@query(f"with {_AC} select score_id, track_idx, bar, case when count(*) >= 18 then '18+' else count(*)::varchar end as density from ac group by all".replace("from ac group by all", "from ac group by score_id, track_idx, bar"))
def ac_bar_note_density(spark, sf):
    return controls.bar_note_density(_ac(spark, sf))


_LEN = ", ".join(f"max((duration = {n})::int) as {name.lower()}" for name, n in controls.LENGTHS.items())


@query(f"with {_AC} select score_id, track_idx, bar, {_LEN} from ac group by score_id, track_idx, bar")
def ac_bar_note_duration(spark, sf):
    return controls.note_durations(_ac(spark, sf), ["score_id", "track_idx", "bar"])


@query(f"with {GRID}, p as (select score_id, track_idx, time, count(*) n from gr group by all) select score_id, track_idx, 1::bigint as min_polyphony, greatest(1, least(6, max(n)))::bigint as max_polyphony from p group by score_id, track_idx")
def ac_track_onset_polyphony(spark, sf):
    return controls.track_onset_polyphony(base.grid_notes(spark, sf))


@query(f"with {GRID} select score_id, track_idx, {_LEN} from gr group by score_id, track_idx")
def ac_track_note_duration(spark, sf):
    return controls.note_durations(base.grid_notes(spark, sf), ["score_id", "track_idx"])


@query(f"""with {GRID}, b as (select score_id, track_idx, unnest(generate_series(0, max(time) // 32)) bar from gr group by score_id, track_idx), c as (select b.score_id, b.track_idx, b.bar, count(gr.time) n from b left join gr on gr.score_id = b.score_id and gr.track_idx = b.track_idx and gr.time // 32 = b.bar group by all)
  select score_id, track_idx, least(18, min(n))::bigint as min_density, least(18, max(n))::bigint as max_density from c group by score_id, track_idx""")
def ac_track_note_density(spark, sf):
    return controls.track_note_density(base.grid_notes(spark, sf), BAR)


@query(f"""with {GRID}, c as (select distinct score_id, track_idx, pitch, kind, t // 32 bar, t % 32 pos from (select score_id, track_idx, pitch, 0 kind, time t from gr union all select score_id, track_idx, pitch, 1, time + duration from gr)),
  n as (select score_id, track_idx, bar, count(*) n from c group by all), s as (select a.score_id, a.track_idx, a.bar, b.bar other, count(*) s from c a join c b on a.score_id = b.score_id and a.track_idx = b.track_idx and a.pitch = b.pitch and a.kind = b.kind and a.pos = b.pos and b.bar between a.bar + 1 and a.bar + 3 group by all),
  p as (select x.score_id, x.track_idx, coalesce(s.s, 0) / x.n::double v from n x join n y on x.score_id = y.score_id and x.track_idx = y.track_idx and y.bar between x.bar + 1 and x.bar + 3
    left join s on s.score_id = x.score_id and s.track_idx = x.track_idx and s.bar = x.bar and s.other = y.bar), q as (select score_id, track_idx, round(sum(v) / count(*), 9) similarity from p group by all)
  select score_id, track_idx, similarity, floor(similarity * 9 + 0.5)::bigint as repetition from q""")
def ac_track_repetition(spark, sf):
    return controls.track_repetition(base.grid_notes(spark, sf), BAR)


@query(f"""with {_AC}, b as (select distinct score_id, track_idx, bar from ac), r as (select *, row_number() over (partition by score_id, track_idx order by {_u(1, 'score_id', 'track_idx', 'bar')}, bar) r, count(*) over (partition by score_id, track_idx) n from b)
  select score_id, track_idx, bar from r where r <= round_even(n * 0.3::double, 0)""")
def ac_random_bars(spark, sf):
    return controls.random_indexes(_ac(spark, sf).select("score_id", "track_idx", "bar").distinct(), 0.3)


# corruption


def _parts_sql(name: str, src: str, n: str, k: str, seed: int) -> str:
    return f"""{name}_1 as (select score_id, seq_id, greatest(1, least({k}, {n})) k, unnest(generate_series(1, {n})) i from {src} where {n} > 0),
{name}_2 as (select *, row_number() over (partition by score_id, seq_id order by i = 1, {_u(seed, 'score_id', 'seq_id', 'i')}, i) r from {name}_1),
{name} as (select score_id, seq_id, i, (sum(case when i > 1 and r <= k - 1 then 1 else 0 end) over (partition by score_id, seq_id order by i) + 1)::bigint part from {name}_2)"""


def _mask_sql(density: float, span: float, seed: int = 1) -> str:
    return f"""mz_0 as (select score_id, seq_id, n, greatest(1, least(round_even(n * {density}::double, 0)::bigint, n - 1)) nz from sq where n > 1),
mz as (select score_id, seq_id, nz, n - nz cl, greatest(1, least(round_even(nz / {span}::double, 0)::bigint, nz, n - nz)) sp from mz_0), {_parts_sql('pn', 'mz', 'nz', 'sp', seed)}, {_parts_sql('pc', 'mz', 'cl', 'sp', seed + 1)},
mask as materialized (select score_id, seq_id, row_number() over (partition by score_id, seq_id order by part, noise, i) - 1 as pos, noise from (select *, 1 noise from pn union all select *, 0 from pc))"""


@query(f"with {_SEQS}, {_parts_sql('rp', 'sq', 'n', '5', 7)} select score_id, seq_id, i, part from rp")
def random_segmentation(spark, sf):
    return corrupt.random_parts(_seqs(spark, sf).withColumn("k", F.lit(5).cast("bigint")), SEQ, "n", "k", uniform(7, *SEQ, "i"))


@query(f"with {_SEQS}, {_mask_sql(0.15, 3.0)} select score_id, seq_id, pos, noise from mask")
def span_mask(spark, sf):
    return corrupt.noise_mask(_seqs(spark, sf), SEQ, "n", 0.15, 3.0)


def _sentinel_sql(side: str, value: int) -> str:
    return f"""select score_id, seq_id, '{side}' as side, row_number() over (partition by score_id, seq_id order by pos) as ord, id from (
  select score_id, seq_id, pos, case when noise = {value} then 9000 + sum(case when noise = {value} and (pv is null or pv <> {value}) then 1 else 0 end) over (partition by score_id, seq_id order by pos) - 1 else id end::bigint as id, noise, pv
  from (select m.*, p.id, lag(noise) over (partition by score_id, seq_id order by pos) pv from mask m join ps p using (score_id, seq_id, pos))) where noise <> {value} or pv is null or pv <> {value}"""


@query(f"with {_SEQS}, {_POS}, {_mask_sql(0.15, 3.0)} {_sentinel_sql('encoder', 1)} union all {_sentinel_sql('decoder', 0)}")
def sentinel_spans(spark, sf):
    return corrupt.span_corruption(_seqs(spark, sf), SEQ, "ids", 0.15, 3.0, 9000)


@query("""with t as (select score_id, seq_id, ids, tokens from (select *, row_number() over (partition by score_id, seq_id order by case when len(tokens) > 0 then 0 else 1 end, loaded_at) n from token_file) where n = 1),
  p as (select score_id, seq_id, unnest(range(greatest(coalesce(len(ids), 0), coalesce(len(tokens), 0)))) pos, unnest(ids) id, unnest(tokens) token from t), r as (select score_id, seq_id, pos, coalesce(p.token, v.token) token from p left join vocab v on v.id = p.id),
  q as (select *, split_part(token, '_', 1) k from r) select score_id, seq_id, pos, 'bar' as mark from q where k = 'Bar' union all select score_id, seq_id, pos, 'beat' from q where token = 'Position_0'
  union all select score_id, seq_id, pos, 'note' from q where k in ('Pitch', 'PitchDrum') union all select score_id, seq_id, pos, 'time' from q where k in ('Position', 'TimeShift')""")
def structure_marks_all(spark, sf):
    """Marks of every record: where tokens are missing, those of its ids; learned merges, which vocab doesn't have, get no mark."""
    from pyspark.sql import Window

    first = Window.partitionBy(*SEQ).orderBy(F.coalesce(F.size("tokens") > 0, F.lit(False)).desc(), "loaded_at")
    d = table(spark, sf, "token_file").select(*SEQ, F.coalesce("ids", F.array().cast("array<int>")).alias("id"), F.coalesce("tokens", F.array().cast("array<string>")).alias("token"), F.row_number().over(first).alias("_n")).where("_n = 1")
    rows = d.select(*SEQ, F.posexplode(F.arrays_zip("id", "token")).alias("pos", "x")).select(*SEQ, F.col("pos").cast("bigint").alias("pos"), "x.*")
    names = table(spark, sf, "vocab").select("id", F.col("token").alias("name"))
    return corrupt.structure_marks(rows.join(F.broadcast(names), "id", "left").select(*SEQ, "pos", F.coalesce("token", "name").alias("token")), SEQ)


_MARKS = {"bar": [4], "beat": [10], "note": list(range(42, 131))}


def _denoise_query(task: str):
    density, span, mark = corrupt.TASKS[task]
    sql = f"with {_SEQS}, {_POS}, {_mask_sql(density, span)}, md as materialized (select p.score_id, p.seq_id, p.pos, p.id, m.noise from ps p join mask m using (score_id, seq_id, pos))"
    if mark:
        ids = ", ".join(map(str, _MARKS[mark]))
        w = "over (partition by score_id, seq_id order by pos"
        sql += f""", a1 as (select *, case when id in ({ids}) then pos end b, case when noise = 1 and coalesce(lag(noise) {w}), 0) = 0 then 1 else 0 end st from md),
  a2 as materialized (select *, min(b) {w} rows between current row and unbounded following) nx, max(b) over (partition by score_id, seq_id) fin, count(*) over (partition by score_id, seq_id) n, sum(st) {w}) sp from a1),
  a3 as (select score_id, seq_id, sp, arg_min(coalesce(nx, fin, pos), pos) st, count(*) k, max(n) n from a2 where noise = 1 group by score_id, seq_id, sp),
  a4 as (select distinct score_id, seq_id, unnest(generate_series(st, least(st + k, n) - 1)) pos from a3)
  select score_id, seq_id, pos, id, case when a4.pos is not null then 1 else 0 end as noise from md left join a4 using (score_id, seq_id, pos)"""
    else:
        sql += " select score_id, seq_id, pos, id, noise from md"

    def f(spark, sf):
        return corrupt.denoise(_seqs(spark, sf), SEQ, "ids", task, _MARKS)

    f.__name__ = f"denoise_{task}"
    query(sql)(f)


for _task in corrupt.TASKS:
    _denoise_query(_task)

_TYPES = {"Pitch": (42, 130), "Velocity": (131, 160), "Duration": (161, 220)}


def _rows(spark, sf) -> DataFrame:
    return corrupt.positions(_seqs(spark, sf), SEQ, "ids")


_LOW = "case " + " ".join(f"when id between {a} and {b} then {a}" for a, b in _TYPES.values()) + " end"
_HIGH = "case " + " ".join(f"when id between {a} and {b} then {b}" for a, b in _TYPES.values()) + " end"


@query(f"""with {_SEQS}, {_POS}, a as (select *, {_LOW} lo, {_HIGH} hi from ps), b as (select *, row_number() over (partition by score_id, seq_id, lo is not null order by {_u(1, 'score_id', 'seq_id', 'pos')}, pos) r, count(*) over (partition by score_id, seq_id, lo is not null) k from a)
  select score_id, seq_id, pos, case when lo is not null and r <= round_even(k * 0.2::double, 0) then lo + floor({_u(2, 'score_id', 'seq_id', 'pos')} * (hi - lo + 1)) else id end::int as id from b""")
def attribute_denoise(spark, sf):
    return corrupt.attribute_denoise(_rows(spark, sf), SEQ, _TYPES)


@query(f"""with {_SEQS}, {_POS}, a as (select *, arg_min(pos, {_u(1, 'score_id', 'seq_id', 'pos')}) filter (id = 4 and pos > 0 and pos >= floor(n * 0.2::double) and pos < floor(n * 0.5::double)) over (partition by score_id, seq_id) c from ps)
  select score_id, seq_id, pos, id, (pos >= coalesce(c, floor(n * 0.2::double)))::int as side from a""")
def continuation(spark, sf):
    return corrupt.continuation(_rows(spark, sf), SEQ, F.col("id") == 4)


_BARRED = f"{_SEQS}, {_POS}, br as (select *, sum(case when id = 4 then 1 else 0 end) over (partition by score_id, seq_id order by pos)::bigint bar from ps)"


def _barred(spark, sf) -> DataFrame:
    return corrupt.with_bars(_rows(spark, sf), SEQ, 4)


@query(f"with {_BARRED} select score_id, seq_id, n, pos, id, bar from br where bar = 0 or {_u(1, 'score_id', 'seq_id', 'bar')} >= 0.3")
def bar_drop(spark, sf):
    return corrupt.drop_bars(_barred(spark, sf), SEQ, 0.3)


@query(f"with {_BARRED} select score_id, seq_id, row_number() over (partition by score_id, seq_id order by bar > 0, case when bar > 0 then {_u(1, 'score_id', 'seq_id', 'bar')} end, bar, pos) as ord, id from br")
def bar_permute(spark, sf):
    return corrupt.permute_bars(_barred(spark, sf), SEQ)


@query(f"with {_SEQS}, {_POS} select score_id, seq_id, n, pos, id from ps where {_u(1, 'score_id', 'seq_id', 'pos')} >= 0.15")
def token_deletion(spark, sf):
    return corrupt.delete_tokens(_rows(spark, sf), SEQ, 0.15)


@query(f"""with {_SEQS}, {_POS}, a as (select *, {_u(1, 'score_id', 'seq_id', 'pos')} < 0.15 c, {_u(2, 'score_id', 'seq_id', 'pos')} u from ps)
  select score_id, seq_id, pos, case when c then case when u < 0.8 then 3 when u < 0.9 then floor({_u(3, 'score_id', 'seq_id', 'pos')} * 486) else id end else id end::int as id, case when c then id else -100 end::int as label from a""")
def bert_mask(spark, sf):
    return corrupt.bert_mask(_rows(spark, sf), SEQ, 3, 486)


@query(f"""with {_SEQS}, {_POS}, a as (select *, {_u(1, 'score_id', 'seq_id')} u, max({_u(1, 'score_id', 'seq_id')}) over (partition by score_id) m from ps) select score_id, seq_id, n, pos, id from a where u >= 0.3 or u = m""")
def track_drop(spark, sf):
    return corrupt.drop_tracks(_rows(spark, sf), "score_id", "seq_id", 0.3)


@query(f"""with {_BARRED}, h as (select score_id, bar, 1 k, seq_id, pos, id from br where id <> 4 union all select distinct score_id, bar, 0, null::int, null::bigint, 4 from br where id = 4)
  select score_id, row_number() over (partition by score_id order by bar, k, seq_id, pos) as ord, id from h""")
def merge_by_bar(spark, sf):
    return corrupt.merge_by_bar(_barred(spark, sf), "score_id", "seq_id", 4)


# batches

_TEXT = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


@query(f"with {_SEQS}, a as (select score_id, seq_id, list_concat([1], ids[1:254], case when n <= 254 then [2] else [] end) x from sq) select score_id, seq_id, array_to_string(x, ',') as ids from a")
def bos_eos_truncate(spark, sf):
    d = _seqs(spark, sf).withColumn("ids", collate.bos_eos(F.col("ids"), 256, 1, 2))
    return d.select(*SEQ, _TEXT("ids").alias("ids"))


@query(f"""with {_SEQS}, a as (select *, max(n) over (partition by score_id) m from sq) select score_id, seq_id, array_to_string(list_concat(ids, list_transform(range(m - n), lambda i: 0)), ',') as input_ids,
  array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(m - n), lambda i: 0)), ',') as attention_mask, array_to_string(list_concat(ids, list_transform(range(m - n), lambda i: -100)), ',') as labels from a""")
def collate_pad(spark, sf):
    d = collate.collate(_seqs(spark, sf), ["score_id"], "ids", 0)
    return d.select(*SEQ, *[_TEXT(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("""with n as (select distinct token from token_file, unnest(tokens) u(token) where token is not null and token not in (select token from vocab))
  select token, id::bigint as id from vocab union all select token, (select max(id) from vocab) + row_number() over (order by token) from n""")
def merge_vocab_all(spark, sf):
    """The whole of vocab keeps its ids."""
    music = table(spark, sf, "token_file").select(F.explode("tokens").alias("token")).where("token is not null").distinct()
    return collate.merge_vocabularies(table(spark, sf, "vocab").select("token", "id"), music)


@query("with w as (select token, id, try_cast(regexp_extract(token, '^<extra_id_([0-9]+)>$', 1) as bigint) i from vocab), x as (select *, row_number() over (order by i) - 1 k from w where i is not null) select token, id from x where i = k")
def sentinel_discovery_all(spark, sf):
    """Over vocab's own names and ids; a vocab without sentinels gives no rows."""
    return collate.sentinels(table(spark, sf, "vocab").select("token", "id"))


def _prompt_sql() -> str:
    names = list(collate.PROMPTS)
    task = "case " + " ".join(f"when u < {(i + 1) / len(names)!r} then '{t}'" for i, t in enumerate(names[:-1])) + f" else '{names[-1]}' end"
    fill = lambda o: "'" + o.replace("{}", "' || n_bars || '", 1).replace("{}", "' || n_beats || '") + "'"
    text = "case " + " ".join(f"when task = '{t}' then case " + " ".join(f"when w < {i / len(o)!r} then {fill(x)}" for i, x in enumerate(o[:-1], 1)) + f" {'else' if len(o) > 1 else 'when true then'} {fill(o[-1])} end" for t, o in collate.PROMPTS.items()) + " end"
    return f"with {GRID}, {_NB}, a as (select score_id, n_bars, n_bars * 4 n_beats, {_u(1, 'score_id')} u, {_u(2, 'score_id')} w from nb), b as (select *, {task} as task from a) select score_id, n_bars, n_beats, task, {text} as prompt from b"


@query(_prompt_sql())
def prompt_sample(spark, sf):
    return collate.prompts(_n_bars(spark, sf).withColumn("n_beats", F.col("n_bars") * 4), ["score_id"])


@query(f"with {_SEQS}, p as (select *, unnest(generate_series(0, n - 17, 256)) f from sq where n > 16) select score_id, seq_id, f // 256 as piece, array_to_string(list_concat(case when f = 0 then [1] else [] end, ids[f + 1:f + 256], case when f + 256 >= n then [2] else [] end), ',') as ids from p")
def dataset_chunks(spark, sf):
    d = collate.chunks(_seqs(spark, sf), SEQ, "ids", 256, 16, 1, 2)
    return d.select(*SEQ, "piece", _TEXT("ids").alias("ids"))


@query(f"""with {_SEQS}, a as (select *, (ceil(max(n) over (partition by score_id) / 128.0) * 128)::bigint m from sq) select score_id, seq_id, array_to_string(list_concat(list_transform(range(m - n), lambda i: 0), ids), ',') as input_ids,
  array_to_string(list_concat(list_transform(range(m - n), lambda i: 0), list_transform(ids, lambda i: 1)), ',') as attention_mask, array_to_string(list_concat(list_transform(range(m - n + 1), lambda i: -100), ids[2:]), ',') as labels from a""")
def collate_left_multiple(spark, sf):
    d = collate.collate(_seqs(spark, sf), ["score_id"], "ids", 0, left=True, shift=True, multiple=128)
    return d.select(*SEQ, *[_TEXT(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


# between notes

_CHORD_SQL = "case k " + " ".join(f"when '{','.join(map(str, s))}' then '{n}'" for n, s in harmony.CHORDS.items()) + " end"


@query(f"""with {GRID}, o as (select score_id, track_idx, time, list_sort(list({{'pitch': pitch, 'e': time + duration}}))[1:10] n from gr group by score_id, track_idx, time),
  c as (select *, array_to_string(list_transform(n, lambda x: x.pitch - n[1].pitch), ',') k from o where len(n) between 3 and 5 and len(list_filter(n, lambda x: abs(x.e - n[1].e) > 4)) = 0 and n[-1].pitch - n[1].pitch <= 24),
  d as (select *, {_CHORD_SQL} q from c) select score_id, track_idx, time::bigint as time, {harmony.CLASSES!r}[n[1].pitch % 12 + 1] || ':' || q as chord from d where q is not null""")
def chords(spark, sf):
    return harmony.chords(base.grid_notes(spark, sf), DEFAULT.tpb)


@query()
def chords_within_offset(spark, sf):
    return harmony.chords_within(base.grid_notes(spark, sf), DEFAULT.tpb)


@query(f"""with {GRID}, a as (select *, lag(time) over w t, lag(pitch) over w p, row_number() over w as ord from gr where not is_drum window w as (partition by score_id, track_idx order by time, duration, pitch, velocity)),
  b as (select *, t is null or t <> time as fresh from a), c as (select *, case when fresh or abs(pitch - p) > 16 then pitch end st from b),
  d as (select *, last_value(st ignore nulls) over (partition by score_id, track_idx order by ord rows between unbounded preceding and 1 preceding) o from c)
  select score_id, track_idx, ord, case when fresh and time - t <= 8 and abs(pitch - o) <= 16 then 'PitchIntervalTime_' || (pitch - o) when not fresh and abs(pitch - p) <= 16 then 'PitchIntervalChord_' || (pitch - p) else 'Pitch_' || pitch end as token from d""")
def pitch_intervals(spark, sf):
    return harmony.pitch_intervals(base.grid_notes(spark, sf), DEFAULT.tpb)


@query(f"""with {GRID}, a as (select score_id, row_number() over w as ord, time::bigint as time, program, lag(program) over w p from gr window w as (partition by score_id order by time, track_idx, duration, pitch, velocity)) select score_id, ord, time, program from a where p is null or p <> program""")
def program_changes(spark, sf):
    return harmony.program_changes(base.grid_notes(spark, sf))


def _rests_sql() -> str:
    from tonegrid.plans.music import _TRIPLE, _greedy, _places
    from tonegrid.plans.streams import _REST

    q = "((time - en) % 96)"
    rests = f"""list_transform(list_concat(list_transform(range((time - en) // 96), lambda i: 96), case when {q} >= 16 and {q} % 4 > 0 then [{q} - {q} % 4, {q} % 4] when {q} between 8 and 15 and {q} % 2 > 0 then [{q} - 1, 1] when {q} > 0 then [{q}] else [] end), lambda n: 'Rest_' || {_REST})"""
    rows = f"""select score_id, track_idx, nord, list_concat(case when time <> lt and time - en >= 1 then {rests} else {_greedy('time - lt')} end, [{_TRIPLE}]) tokens
      from (select *, coalesce(lag(time) over (partition by score_id, track_idx order by nord), 0) lt, coalesce(max(time + duration) over (partition by score_id, track_idx order by nord rows between unbounded preceding and 1 preceding), 0) en from grn)"""
    return f"with {GRID} {_places(rows, 'nord')}"


@query(_rests_sql())
def tsd_rests_encode(spark, sf):
    return harmony.encode_tsd_rests(base.grid_notes(spark, sf))


@query(f"with {GRID} select score_id, track_idx, is_drum, {_N} from gr")
def tsd_rests_decode(spark, sf):
    return harmony.decode_tsd_rests(harmony.encode_tsd_rests(base.grid_notes(spark, sf)))
