"""DuckDB SQL that states the same results independently of the Spark code.

URL filters (FP-growth), both classifiers, suffix-array dedup (byte strings) and SimHash (XXH64) have none; the tests hold them
against brute-force versions and held-out labels.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] as win from (select doc_id, l, unnest(range(1, len(l) - 1)) as p from l)),
r as (select doc_id, p, row_number() over (partition by win order by doc_id nulls first, p) as n from w),
c as (select doc_id, list(distinct p + k) as gone from r, (values (0), (1), (2)) as t(k) where n > 1 group by doc_id)
select l.doc_id,
  case when gone is null then text else array_to_string([x[1] for x in list_zip(l, range(1, len(l) + 1)) if not list_contains(gone, x[2])], chr(10)) end as text,
  coalesce(len(l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed
from l left join c using (doc_id)
"""

OP2 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (select distinct item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as win, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0)),
sizes as (select distinct n from wins),
places as (select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, p, places.n from places join wins using (win)),
covered as (select doc_id, count(distinct p + k) as n_hit from (select doc_id, p, unnest(range(0, n)) as k from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, {rank} as r, '{kind}' as kind, start, start + len_ as stop from (
  select doc_id, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0) as start, length(whole[i]) as len_, length(tested[i]) as m
  from (select doc_id, whole, tested, gaps, unnest(range(1, len(whole) + 1)) as i from (
    select doc_id, regexp_extract_all(t, '{pattern}') as whole, regexp_extract_all(t, '{pattern}', {group}) as tested, string_split_regex(t, '{pattern}') as gaps from d))) where m >= {least}"""


OP3 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({_spans("assign", 0, _ASSIGN, 2, 6)} union all {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} union all {_spans("hex", 2, "[0-9a-f]+", 0, 24)}),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' order by start, r) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (doc_id)
"""

OP5 = rf"""
with d as (select doc_id, source, len({_SPACE_WORDS})::bigint as size,
    strlen(coalesce(text, '')) - strlen(translate(coalesce(text, ''), '0123456789#*$%&|<>', '')) as odd,
    (('0x' || substr(md5('5:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from documents),
k as (select doc_id, source, size, -ln(u) / greatest(0.2::double, 1.0::double - odd::double / (greatest(size, 1) * 2.0::double)) as key from d),
s as (select source, sum(size)::bigint as source_size, (array[1, 2, 3])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from k group by source),
c as (select *, source_size * 3 as cap, sum(source_size) over () as total from s),
o as (select *, coalesce(sum(cap) over (order by cap::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as cap_before,
    sum(w) over (order by cap::double / w, source nulls last rows between current row and unbounded following) as w_left from c),
v as (select *, (total - cap_before)::double / w_left as lev from o),
f as (select *, cap <= w * lev as full_ from v),
t as (select source, source_size, case when full_ then cap::double else w * max(case when not full_ then lev end) over () end as target from f),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from t),
r as (select *, floor(target)::bigint - epochs * source_size as rest from e),
p as (select k.*, r.source_size, r.target, r.epochs, r.rest, sum(size) over (partition by k.source order by key, doc_id rows between unbounded preceding and current row) - size as before
    from k join r on k.source is not distinct from r.source)
select doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::bigint as taken from p
"""


def _bucket(v: str) -> str:
    return f"({v} // pow(2, greatest(length(bin({v})) - 8, 0))::bigint) * pow(2, greatest(length(bin({v})) - 8, 0))::bigint"


def _reach(k: int, unit: str) -> str:
    """The fences of rate k: five spreads outside the quartiles."""
    q = lambda n: f"max(case when feature = {k} then q{n} end)"
    reach = f"5 * greatest({q(3)} - {q(1)}, {unit})"
    return f"{q(3)} + {reach} as hi{k}, {q(1)} - {reach} as lo{k}"


def _median(feature: int) -> str:
    return f"greatest(max(case when feature = {feature} then q2 end), 1)"


def _pick(c: str) -> str:
    wide = f"case when l.total >= 50 then l.{c} else x.{c} end"
    own = f"least(a.{c}, 3 * {wide})" if c.startswith("hi") else f"a.{c}"
    return f"case when a.total >= 50 then {own} else {wide} end as {c}"


OP6 = rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, {_SPACE_WORDS} as w from documents),
wins as (select doc_id, p, array_to_string(w[p : p + 7], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as p from d)),
again as (select doc_id, p from wins qualify count(*) over (partition by doc_id, win) > 1),
reps as (select doc_id, count(distinct p + k) as n from again, range(0, 8) as x(k) group by doc_id),
lines as (select doc_id, count(*) as lines, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
f as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(lines.lines, 0)::bigint as lines, coalesce(reps.n, 0)::bigint as n_repeat_words
  from d left join reps using (doc_id) left join lines using (doc_id)),
g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, n_symbols * 1000 // greatest(n_words, 1) as v1, word_chars * 1000 // greatest(n_words, 1) as v2,
    n_dup_lines * 1000 // greatest(lines, 1) as v3, n_repeat_words * 1000 // greatest(n_words, 1) as v4 from f),
v as (select lang, source, unnest([1, 2, 3, 4, 5, 6]) as feature, unnest([v1, v2, v3, v4, n_words, lines]) as v from g where not base_failed),
b as (select lang, source, feature, {_bucket("v")} as b from v),
levels as (select 0 as lev, lang, source, feature, b from b union all select 1, lang, null, feature, b from b union all select 2, null, null, feature, b from b),
cum as (select lev, lang, source, feature, b, sum(count(*)) over (partition by lev, lang, source, feature order by b) as seen, sum(count(*)) over (partition by lev, lang, source, feature) as total
  from levels group by lev, lang, source, feature, b),
q as (select lev, lang, source, feature, max(total) as total, min(b) filter (seen >= total * 0.25) as q1, min(b) filter (seen >= total * 0.5) as q2, min(b) filter (seen >= total * 0.75) as q3 from cum group by lev, lang, source, feature),
fences as (select lev, lang, source, max(total) as total, {_reach(1, f"1000 // {_median(5)}")}, {_reach(2, "max(case when feature = 2 then q2 end) // 32")}, {_reach(3, f"1000 // {_median(6)}")}, {_reach(4, f"16000 // {_median(5)}")} from q group by lev, lang, source),
pick as (select a.lang, a.source, {", ".join(_pick(f"{end}{k}") for k in (1, 2, 3, 4) for end in ("hi", "lo"))}
  from fences a join fences l on l.lev = 1 and l.lang is not distinct from a.lang join fences x on x.lev = 2 where a.lev = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce(v{k} between lo{k} and hi{k}, true)" for k in (1, 2, 3, 4))} as kept
from g left join pick on g.lang is not distinct from pick.lang and g.source is not distinct from pick.source
"""

OP11 = """
with r as (select vec_id, label, [floor(256 * x::double) for x in embedding] as q
  from (select vec_id, embedding, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label from embeddings)
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id, list_dot_product(a.q, r.q)::bigint as score from r a, r where a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10
"""

OP12 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, first_value(page_id) over (partition by payload_digest order by page_id) as origin from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and origin <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and origin <> page_id then origin end as refers_to
from f
"""

OP13 = """
with recursive crc as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t from (select unnest(range(256)) as i)),
runs as (select doc_id, r, count(*) as n from (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as r from documents) group by all),
bytes as (select r, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || r)) as x from runs where length(r) >= 5),
sums as (select r, n, xor(list_reduce([('0x' || x[2 * k - 1 : 2 * k])::bigint for k in range(1, len(x) // 2 + 1)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as h from bytes, crc),
cut as (select case when h % 97 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, n from sums),
v as materialized (select word, sum(n)::bigint as n from cut where length(word) >= 5 group by word having sum(n) >= 3),
del as materialized (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as s from (select word, n, unnest(range(1, length(word) + 1))::int as k from v)),
pairs as materialized (select a.word, b.word as other, b.n as m from del a join del b on a.k = b.k and a.s = b.s and a.word <> b.word
  union select a.word, b.word, b.n from del a join v b on a.s = b.word union select b.word, a.word, a.n from del a join v b on a.s = b.word),
best as (select word, count(*)::bigint as n_near, first(other order by m desc, other) as other, max(m) as m from pairs group by word),
f as materialized (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * v.n then other end as form, case when m >= 2 * v.n then m end as form_n from v left join best using (word)),
walk as (select word, word as at from f union all select walk.word, f.form from walk join f on f.word = walk.at where f.form is not null)
select f.word, form, walk.at as root, n, n_near, form_n from f join walk on walk.word = f.word where walk.at in (select word from f where form is null)
"""

SQL: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op2_decontamination": OP2,
    "op3_secret_scan": OP3,
    "op5_source_mixing": OP5,
    "op6_quality_rules": OP6,
    "op11_hard_negatives": OP11,
    "op12_warc_revisits": OP12,
    "op13_spelling_variants": OP13,
}
