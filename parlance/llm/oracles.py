"""DuckDB SQL for those queries that SQL can say."""

from __future__ import annotations

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Equal sets are one node; links join on shared shingles; components by reachability.
OP4 = rf"""with recursive w as (select doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)) as sh from w),
 k as (select doc_id, cast(len(sh) as bigint) as n, md5(array_to_string(sh, chr(10))) as h, sh from s),
 g as (select min(doc_id) as id, any_value(n) as n, h, any_value(sh) as sh from k where n > 0 group by h),
 t as (select id, n, unnest(sh) as x from g),
 c as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from t a join t b on a.x = b.x and a.id <> b.id group by a.id, b.id),
 l as (select a, b from c where 100 * shared >= 90 * (na + nb - shared)),
 r(a, b) as (select id, id from g union select r.a, l.b from r join l on r.b = l.a),
 m as (select a, min(b) as low from r group by a)
 select k.doc_id, k.n as n_shingles, coalesce(m.low, k.doc_id) as component_id from k left join g on k.h = g.h and k.n > 0 left join m on m.a = g.id"""

OP5 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
 where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
 r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s) select query_id, rank, vec_id, score from r where rank <= 5"""

OP6 = rf"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 i as (select cast(item_id as varchar) as item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
 x as (select item_id, w, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from i where len(w) > 0),
 b as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as win from x),
 p as (select r, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from b) where len(w) >= n),
 f as (select r, s, p.n, item_id from p join b on p.n = b.n and array_to_string(w[s:s + p.n - 1], ' ') = win),
 h as (select r, count(distinct place) as n_hit from (select r, unnest(range(s, s + n)) as place from (select distinct r, s, n from f)) group by r),
 t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from f) group by r)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
 from d left join h using (r) left join t using (r)"""

OP10 = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 e as (select *, replace(replace(text, '\', '\\'), '<|', '<\|') as t2, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n') as r2 from c),
 g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
 string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role, text) as loss, cast(sum(12 + length(r2) + 1 + length(t2) + 11) as bigint) as formatted_chars from e group by conv_id)
 select conv_id, n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g"""

#: CRC-32 of a text's UTF-8 bytes: eight shifts a byte, by a table.
CRC_TABLE = "crc_table as (select list(v order by i) as t from (select i, list_reduce([i] || range(8)::bigint[], lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end) as v from (select unnest(range(256))::bigint as i)))"


def crc32(text: str) -> str:
    """SQL of the CRC-32 of ``text``, where ``crc_table`` is joined as one row with the column t."""
    digits = f"hex(encode({text}))"
    byte = "(strpos('0123456789ABCDEF', {0}[i]) - 1) * 16 + strpos('0123456789ABCDEF', {0}[i + 1]) - 1".format(digits)
    bytes_ = f"list_transform(range(1, length({digits}), 2), lambda i: cast({byte} as bigint))"
    return f"xor(4294967295, list_reduce([4294967295::bigint] || {bytes_}, lambda v, b: xor(t[xor(v % 256, b) + 1], v // 256)))"


#: Every edit of a row, and insert runs before it, for each state: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
MOVES = """m0(state, next_state, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
 runs(begin, state, run, said) as (select state, state, '', [] :: varchar[] from m0 union all select begin, next_state, run || 'I', list_append(said, role || ':') from runs join m0 using (state) where length(run) < 2),
 keeps(state, initial, next_state) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
 moves as (select begin, run || 'D' as code, state as ends, 2 * length(run) + 3 as cost, said, cast(null as varchar) as initial, 'D' as op, cast(null as varchar) as role from runs
 union all select begin, run || 'R', next_state, 2 * length(run) + 2, said, null, 'R', role from runs join m0 using (state)
 union all select begin, run || 'K', next_state, 2 * length(run), said, initial, 'K', null from runs join keeps using (state))"""

OP11 = rf"""with recursive {CRC_TABLE}, {MOVES},
 k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations, crc_table),
 d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from k where kind <> 0),
 o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from d),
 f as (select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by n) as last_initial,
 case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' end as fault from o),
 dp(conv_id, n, state, cost, audit, said) as (select distinct conv_id, cast(0 as bigint), 0, cast(0 as bigint), '', [] :: varchar[] from f
 union all select conv_id, n, ends, cost, audit, said from (select *, row_number() over (partition by conv_id, ends order by cost, audit) as rn from (
 select dp.conv_id, f.n, m.ends, dp.cost + m.cost + case when f.fault = 'truncated' and m.op <> 'D' then 1 else 0 end as cost, dp.audit || m.code as audit,
 dp.said || m.said || case m.op when 'D' then [] :: varchar[] when 'K' then [f.role || ':' || f.text] else [m.role || ':' || f.text] end as said
 from dp join f on dp.conv_id is not distinct from f.conv_id and f.n = dp.n + 1 join moves m on m.begin = dp.state and (m.initial is null or m.initial = f.initial) and (m.op = 'D' or f.fault is null or f.fault = 'truncated')) s) where rn = 1),
 last as (select conv_id, max(n) as n from f group by conv_id),
 e as (select dp.conv_id, cost + 2 * length(run) as cost, audit || run as audit, dp.said || r.said as said from dp join last on dp.conv_id is not distinct from last.conv_id and dp.n = last.n join runs r on r.begin = dp.state and (r.state = 3 or r.state = 0)),
 b as (select * from (select *, row_number() over (partition by conv_id order by cost, audit) as rn from e) where rn = 1),
 c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
 count(*) filter (n > 1 and last_initial || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
 select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(b.cost, 0) as bigint) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(array_to_string(b.said, chr(10)), '')) as repaired_sha256
 from (select distinct conv_id from conversations) i left join c on i.conv_id is not distinct from c.conv_id left join b on i.conv_id is not distinct from b.conv_id"""

OP13 = rf"""with {CRC_TABLE},
 d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 dw as (select r, unnest(w) as w from d), bw as (select unnest(regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
 h as (select w, {crc32("w")} % 10000 as b from (select w from dw union select w from bw) x, crc_table),
 s as (select b, count(*) as s from dw join h using (w) group by b), t as (select b, count(*) as t from bw join h using (w) group by b),
 n as (select (select count(*) from dw) as s_all, (select count(*) from bw) as t_all),
 g as (select h.b, cast(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) as bigint) as gain from (select distinct b from h) h left join s using (b) left join t using (b), n),
 x as (select r, count(*) as n_features, sum(gain) as weight from dw join h using (w) join g using (b) group by r),
 y as (select d.r, doc_id, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight, cast('0x' || left(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 8) as bigint) as u from d left join x using (r)),
 z as (select *, weight + cast(floor(-1000 * ln(-ln((u + 0.5::double) / 4294967296))) as bigint) as score from y),
 p as (select r, row_number() over (order by score desc, doc_id nulls last) as rank from z where n_features >= 20)
 select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from p) then rank end as rank from z left join p using (r)"""

ALL = {"op4_ngram_join": OP4, "op5_topk": OP5, "op6_decontamination": OP6, "op10_chat": OP10, "op11_structure_repair": OP11, "op13_resampling": OP13}
