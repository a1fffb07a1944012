"""SQL of the queries that SQL can express over whole tables; the others are tested against brute force on small fixtures."""

_EVENT = """ev as (select distinct score_id, seq_id, ord, type || '_' || value as term from token_events where type is not null and value is not null),
tk as (select score_id, seq_id, any_value(tokens) tokens from token_file where len(tokens) > 0 group by score_id, seq_id),
tt as (select score_id, seq_id, unnest(tokens) term from tk),
al as (select 'event' as field, score_id, seq_id, term from ev union all select 'tokens', score_id, seq_id, term from tt where term is not null),
nr as (select 'event' as field, count(*) n from (select distinct score_id, seq_id from ev) union all select 'tokens', count(*) from tk),
tc as (select field, term, count(*) occurrences, count(distinct (score_id, seq_id)) records from al group by field, term),
tm as (select field, term, occurrences, records, case when records < 3 then 'rare' when records > n * 0.8::double then 'common' else 'useful' end as mark from tc join nr using (field))"""

_PAIRS = """sq as (select distinct score_id, seq_id, id from token_file, unnest(ids) u(id) where len(ids) > 0 and not coalesce(ids_encoded, false) and id is not null),
nn as (select count(*) n_records from (select distinct score_id, seq_id from token_file where len(ids) > 0 and not coalesce(ids_encoded, false))),
oo as (select id, count(*) n from sq group by id),
pp as (select a.id id_a, b.id id_b, count(*) n_ab from sq a join sq b on a.score_id = b.score_id and a.seq_id = b.seq_id and a.id < b.id group by a.id, b.id),
sc as (select id_a, id_b, n_ab, x.n n_a, y.n n_b, n_records, n_ab * n_records / (x.n * y.n)::double as lift,
  case when n_ab < x.n then (1 - y.n / n_records::double) / (1 - n_ab / x.n::double) end as conviction from pp join oo x on x.id = id_a join oo y on y.id = id_b, nn)"""

_PIECES = """with recursive sq as (select score_id, seq_id, any_value(ids) ids, len(any_value(ids)) n from token_file where len(ids) > 0 group by score_id, seq_id),
lg as (select config_name, max_seq_len m, overlap_len o, sq.* from sq join collator_configs on n > max_seq_len),
bt as (select config_name, score_id, seq_id, m, o, n, list_filter(generate_series(1, n - 1), lambda p: ids[p + 1] = bar) cuts from lg, (select min(id) bar from vocab where token = 'Bar_None')),
rc as (
  select config_name, score_id, seq_id, m, o, n, cuts, 0::bigint as piece_no, 0::bigint as first_pos, 0::bigint as nx, false as over from bt
  union all
  select config_name, score_id, seq_id, m, o, n, cuts, piece_no + 1, nx, e - o, n - nx <= m from (
    select *, case when n - nx <= m then n else coalesce(list_max(list_filter(cuts, lambda c: c > nx + o and c <= nx + m)), nx + m) end e from rc where not over))
select config_name, score_id, seq_id, piece_no::int as piece_no, first_pos::int as first_pos, (nx + o - 1)::int as last_pos from rc where piece_no > 0"""

_SPANS = """sq as (select score_id, seq_id, any_value(ids) ids from token_file where len(ids) >= 40 group by score_id, seq_id),
ws as (select score_id, seq_id, p, md5(array_to_string(ids[p + 1:p + 40], ',')) h from (select *, unnest(generate_series(0, len(ids) - 40)) p from sq)),
sh as (select h from ws group by h having min((score_id, seq_id)) <> max((score_id, seq_id))),
hit as (select score_id, seq_id, p, lag(p) over (partition by score_id, seq_id order by p) q from ws where h in (select h from sh)),
rn as (select *, sum(case when p <= q + 40 then 0 else 1 end) over (partition by score_id, seq_id order by p) r from hit),
sp as (select score_id, seq_id, min(p)::int as first_pos, (max(p) + 39)::int as last_pos from rn group by score_id, seq_id, r)"""

_NEAR = """sq as (select distinct score_id, seq_id, md5(array_to_string(ids[p + 1:p + 6], ',')) h from (select score_id, seq_id, ids, unnest(generate_series(0, len(ids) - 6)) p from token_file where len(ids) >= 6)),
on_ as (select distinct score_id, track_idx, ord, pitch from raw_events where event_type = 'NoteOn' and velocity > 0 and pitch is not null and ord is not null),
r5 as (select score_id, track_idx, concat_ws(',', pitch, lead(pitch) over w, lead(pitch, 2) over w, lead(pitch, 3) over w, lead(pitch, 4) over w) h, lead(pitch, 4) over w last from on_ window w as (partition by score_id, track_idx order by ord)),
ru as (select 'sequence' kind, score_id, seq_id idx, h from sq union all select distinct 'track', score_id, track_idx, h from r5 where last is not null),
sz as (select kind, score_id, idx, count(*) n from ru group by kind, score_id, idx),
pr as (select a.kind, a.score_id score_a, a.idx idx_a, b.score_id score_b, b.idx idx_b, count(*) c from ru a join ru b on a.kind = b.kind and a.h = b.h and (a.score_id, a.idx) < (b.score_id, b.idx) group by all),
fd as (select pr.kind, score_a, idx_a, score_b, idx_b from pr join sz x on x.kind = pr.kind and x.score_id = score_a and x.idx = idx_a join sz y on y.kind = pr.kind and y.score_id = score_b and y.idx = idx_b where c * 5 >= 3 * (x.n + y.n - c))"""

SQL: dict[str, str] = {
    "p1_found": f"with {_EVENT} select field, term, mark from tm where mark <> 'useful'",
    "p1_terms": f"with {_EVENT} select field, term, occurrences, records, mark from tm",
    "p2_found": f"with {_PAIRS} select id_a, id_b from sc where n_ab >= 5 and 200 * n_ab >= n_records and n_ab * n_records >= 8 * n_a * n_b",
    "p2_pairs": f"with {_PAIRS} select id_a, id_b, n_ab, n_a, n_b, n_records, lift, conviction from sc",
    "p4_found": _PIECES,
    "p4_kept": "select config_name, score_id, seq_id, any_value(len(ids))::int as n_ids, 0::bigint as n_bad from token_file join collator_configs on len(ids) > max_seq_len group by config_name, score_id, seq_id",
    "p5_found": f"with {_SPANS} select score_id, seq_id, first_pos, last_pos from sp",
    "p5_coverage": f"""with {_SPANS}, al as (select score_id, seq_id, any_value(len(ids))::int n_ids from token_file where len(ids) >= 0 group by score_id, seq_id),
hs as (select score_id, seq_id, sum(last_pos - first_pos + 1)::bigint n_shared from sp group by score_id, seq_id)
select score_id, seq_id, n_ids, coalesce(n_shared, 0) as n_shared, case when n_ids > 0 then coalesce(n_shared, 0) / n_ids::double else 0.0 end as share from al left join hs using (score_id, seq_id)""",
    "p6_found": "select distinct config_name, score_id, seq_id from token_file join collator_configs on len(ids) >= max_seq_len",
    "p6_kept": """with sz as (select score_id, seq_id, any_value(len(ids)) n from token_file where len(ids) > 0 group by score_id, seq_id)
select config_name, count(*) as n_records, sum(n)::bigint as n_ids, 0::bigint as n_lost, 0::bigint as n_over, 0::bigint as n_split, true as tight from sz, collator_configs group by config_name""",
    "p7_found": f"with {_NEAR} select kind, score_a, idx_a, score_b, idx_b from fd",
    "p7_linked": f"""with {_NEAR}, st as (select kind, score_id, idx, md5(string_agg(h, '|' order by h)) s from ru group by kind, score_id, idx),
cl as (select kind, score_id, idx, min((score_id, idx)) over (partition by kind, s) m, count(*) over (partition by kind, s) n_copies from st),
lk as (select kind, s, i, count(*) n from (select kind, score_a s, idx_a i from fd union all select kind, score_b, idx_b from fd) group by all)
select cl.kind, cl.score_id, cl.idx, m[1] as class_score, m[2] as class_idx, n_copies, coalesce(n, 0) as n_links from cl left join lk on lk.kind = cl.kind and lk.s = cl.score_id and lk.i = cl.idx""",
}
