"""DuckDB statements for the numbered operators that SQL can express."""

from __future__ import annotations

from math import erfc, sqrt
from statistics import NormalDist

from varloom.llm import mixing, quality

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _floor_of(v: str) -> str:
    return f"case when {v} < {quality.EXACT_BELOW} then {v} else {v} - {v} % (1::bigint << greatest(length(bin({v})) - 5, 0)::int) end"


def adaptive_quality() -> str:
    """Base columns, sketches by (lang, source), fences and the joined filter."""
    symbols = "".join("\\" + c for c in quality.SYMBOLS)
    measures = [m for m, _, _ in quality.MEASURES]
    long = " union all ".join(f"select lang, source, '{m}' as measure, {m} as value from m where not base_failed" for m in measures)
    sides = [f"{side}_{m}" for side in ("low", "high") for m in measures]

    def fences(name: str, keys: str) -> str:
        lead = f"{keys}, " if keys else ""
        group = f"group by {keys}" if keys else ""
        return f"""
{name}_c as (select {lead}measure, bucket, sum(n) as n from sk group by {lead}measure, bucket),
{name}_u as (select {lead}measure, bucket, sum(n) over (partition by {lead}measure order by bucket) as upto,
  sum(n) over (partition by {lead}measure) as docs from {name}_c),
{name}_q as (select {lead}measure, min(bucket) filter (10 * upto >= docs) as q10, min(bucket) filter (10 * upto >= 5 * docs) as q50,
  min(bucket) filter (10 * upto >= 9 * docs) as q90, max(docs) as docs from {name}_u group by {lead}measure),
{name} as (select {lead}max(docs) as docs,
  {", ".join([f"max(q10 - {quality.FENCE} * (q50 - q10)) filter (measure = '{m}') as low_{m}" for m in measures] + [f"max(q90 + {quality.FENCE} * (q90 - q50)) filter (measure = '{m}') as high_{m}" for m in measures])}
  from {name}_q {group})"""

    def pick(c: str) -> str:
        return f"case when o.docs >= {quality.LEAST_DOCS} then o.{c} when l.docs >= {quality.LEAST_DOCS} then l.{c} else a.{c} end as {c}"

    def inside(m: str) -> str:
        units, chance = next((u, c) for name, u, c in quality.MEASURES if name == m)
        noise = f"floor({quality.WORD_LEN_NOISE} / sqrt(greatest(n_words, 1)))" if m == "word_len_pct" else f"floor({1000 * chance} / greatest({units}, 1)::double)"
        return f"m.{m} between t.low_{m} - {noise} and t.high_{m} + {noise}"

    def per(a: str, b: str, scale: int) -> str:
        return f"coalesce(floor({scale} * {a} / nullif({b}, 0)::double), 0)::bigint"

    return f"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents),
g as (select doc_id, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5),
h as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(words[i:i + 4], chr(10))) as times from g),
r as (select doc_id, i, lead(i) over (partition by doc_id order by i) as next from h where times > 1),
rep as (select doc_id, sum(least(5, coalesce(next - i, 5))) as n from r group by doc_id),
b as (select w.doc_id, lang, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^{symbols}]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep on w.doc_id = rep.doc_id),
m as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {per("word_chars", "n_words", 100)} as word_len_pct,
    {per("n_symbols", "word_chars", 1000)} as symbol_pmil, {per("n_dup_lines", "n_lines", 1000)} as dup_line_pmil,
    {per("n_repeat_words", "n_words", 1000)} as repeat_pmil from b),
v as ({long}),
sk as (select lang, source, measure, {_floor_of("value")} as bucket, count(*) as n from v group by all),
{fences("own", "lang, source")},
{fences("bylang", "lang")},
{fences("whole", "")},
t as (select o.lang, o.source, {", ".join(pick(c) for c in sides)}
  from own o join bylang l on o.lang is not distinct from l.lang cross join whole a)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(inside(m) for m in measures)} as kept, {", ".join(f"m.{m}" for m in measures)}
from m left join t on m.lang is not distinct from t.lang and m.source is not distinct from t.source
"""


def water_filling(seed: int = 0) -> str:
    return f"""
with d as (select doc_id, source, len({_WORDS})::bigint as size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '-')), 1, 12))::bigint as place from documents),
s as (select source, sum(size)::bigint as source_size, ([5, 2, 1])[(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight,
    3 * sum(size)::bigint as cap from d group by source),
f as (select *, sum(source_size) over () as budget, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weights from s),
c as (select *, weight * (budget - capped) > cap * weights as clamped from f),
t as (select source, source_size, case when clamped then cap::double else (weight * (budget - sum(case when clamped then cap else 0 end) over ()))::double
    / sum(case when clamped then 0 else weight end) over () end as target from c),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::int as whole from t),
o as (select d.doc_id, d.source, size, source_size, target, whole, target - whole * source_size as rest,
    coalesce(sum(size) over (partition by d.source order by place % {mixing.BUCKETS}, place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead
  from d join p on d.source is not distinct from p.source),
r as (select *, whole + (rest > 0 and 2 * ahead + size <= 2 * rest)::int as reps from o)
select doc_id, size, source_size, target, (reps * size)::bigint as taken, source, reps from r
"""


JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '{WORD}') as words from documents),
e as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as s from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from e group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from e a join e b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 80 * (x.n + y.n - shared)),
u as (select a, b from l union all select b, a from l),
reach as (select a as doc_id, b as other from u union select reach.doc_id, u.b from reach join u on reach.other = u.a),
least_of as (select doc_id, min(other) as other from reach group by doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(least_of.other, w.doc_id)) as component_id
from w left join n on w.doc_id = n.doc_id left join least_of on w.doc_id = least_of.doc_id
"""

WARC = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload)::bigint as n, sha1(payload) as sha, min(page_id) over (partition by sha1(payload)) as first from p)
select page_id, n as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, (k // 4) * 5 + 1, 5))::int >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to, true as whole
from h
"""

REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, unnest(range(0, length(x) // 2 - 49)) as i, x from d where length(x) >= 100),
v as (select doc_id, i, hash(substr(x, 2 * i + 1, 100)) as h from w),
m as (select h, min(doc_id) as first from v group by h),
s as (select v.doc_id, v.i, m.first from v join m on v.h = m.h),
c as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from s where first < doc_id),
g as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as span from c),
r as (select doc_id, span, min(i) as low, max(i) + 50 as high from g group by doc_id, span),
o as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as kept_from,
    row_number() over (partition by doc_id order by low desc) = 1 as is_last from r),
k as (select o.doc_id, sum(high - low)::bigint as n_removed, count(*)::bigint as n_spans,
    string_agg(substr(x, 2 * kept_from + 1, 2 * (low - kept_from)), '' order by low) || max(case when is_last then substr(x, 2 * high + 1) else '' end) as kept
  from o join d on o.doc_id = d.doc_id group by o.doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""

def resampling(seed: str = "7", buckets: int = 10_000, least_words: int = 20, share: int = 25) -> str:
    """Checksums bit by bit from the polynomial, gains per bucket, scores and ranks."""
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with recursive one as (select b, b::bigint as v, 0 as k from (select unnest(range(256)) as b) union all
  select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from one where k < 8),
byte as materialized (select b, v from one where k = 8),
dw as materialized (select doc_id, {words} as w from documents),
bw as materialized (select {words} as w from benchmark),
df as materialized (select doc_id, f, count(*) as n from (select doc_id, unnest({runs}) as f from dw) group by all),
bf as materialized (select f, count(*) as n from (select unnest({runs}) as f from bw) group by all),
fs as materialized (select f, hex(encode(f)) as x, octet_length(encode(f)) as len from (select f from df union select f from bf)),
pos as (select 0 as d, b, v from byte union all
  select d + 1, p.b, xor(p.v >> 8, t.v) from pos p join byte t on t.b = p.v & 255 where d + 1 < (select max(len) from fs)),
con as (select 0 as n, 4294967295 as s union all
  select n + 1, xor(s >> 8, t.v) from con c join byte t on t.b = c.s & 255 where n < (select max(len) from fs)),
fb as (select f, len, len - i as d, ('0x' || substr(x, (2 * i - 1)::int, 2))::bigint as b from (select *, unnest(range(1, len + 1)) as i from fs)),
crc as materialized (select f, xor(bit_xor(p.v), any_value(xor(c.s, 4294967295))) % {buckets} as bucket
  from fb join pos p on p.d = fb.d and p.b = fb.b join con c on c.n = fb.len group by f),
s as (select bucket, sum(n)::bigint as s from df join crc using (f) group by 1),
t as (select bucket, sum(n)::bigint as t from bf join crc using (f) group by 1),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (coalesce((select sum(s) from s), 0) + {buckets})::double
    / ((coalesce(s, 0) + 1)::double * (coalesce((select sum(t) from t), 0) + {buckets})::double)))::bigint as gain
  from (select distinct bucket from crc) left join s using (bucket) left join t using (bucket)),
m as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from df join crc using (f) join g using (bucket) group by 1),
c as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint as h from dw left join m using (doc_id)),
e as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from c),
k as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from e where n_words >= {least_words})
select e.doc_id, n_words::bigint as n_words, n_features, weight, score, case when place <= {share} * total // 100 then place end as rank
from e left join k using (doc_id)
"""


def randomness(level: float = 0.001, false_share: float = 0.01) -> str:
    """Base spans, the test battery on candidates, the step-up rule per class of lengths and the span lists."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    encodings = [digits + "abcdef", digits + "ABCDEF", lower, upper, "234567" + upper, digits + lower, digits + lower + upper]
    encodings += [x + digits + lower + upper for x in ("+/", "-_", "+/-_")]
    values = ", ".join(f"({i}, '{''.join(sorted(a))}')" for i, a in enumerate(encodings))
    assign = "((?:{}))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)".format(
        "|".join("".join("_?" if c == "_" else f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    )
    kinds = [("assign", 1, assign, 2, 6), ("access", 2, "AKIA[A-Z0-9]+", 0, 20), ("hex", 3, "[0-9a-f]+", 0, 24), ("random", 4, "[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20)]
    found = " union all ".join(
        f"select r, '{k}' as kind, {o} as ord, unnest(range(1, len(hits) + 1)) as i, unnest(list_transform(hits, lambda x: length(x))) as size, "
        f"unnest(list_transform(gaps[:len(hits)], lambda x: length(x))) as gap, unnest(list_transform(cores, lambda x: length(x) >= {least})) as counts, unnest(hits) as token "
        f"from (select r, regexp_extract_all(text, '{p}') as hits, string_split_regex(text, '{p}') as gaps, regexp_extract_all(text, '{p}', {g}) as cores "
        f"from d where regexp_matches(text, '{p}'))"
        for k, o, p, g, least in kinds
    )
    one, two = NormalDist().inv_cdf(1 - level / 3), NormalDist().inv_cdf(1 - level / 6)
    tails = ", ".join(repr(erfc(b / 16 / sqrt(2)) / 2) for b in range(161))
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
enc(e, alphabet) as (values {values}),
ch as materialized (select c, count(*)::double as n from (select unnest(string_split(regexp_replace(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}', '', 'g'), '')) as c from d)
  where length(c) = 1 group by c),
folded as (select e, alphabet, case when instr(alphabet, c) > 0 then instr(alphabet, c) else instr(alphabet, translate(c, '{lower}{upper}', '{upper}{lower}')) end as i, sum(n) as n
  from ch, enc group by all),
law as (select e, sum(n * n) / (sum(n) * sum(n)) as s2, sum(n * n * n) / (sum(n) * sum(n) * sum(n)) as s3,
    sum(case when 2 * i <= length(alphabet) then n else 0 end) / sum(n) as low from folded where i > 0 group by e),
f as materialized ({found}),
p as (select *, sum(gap + size) over (partition by r, kind order by i) as stop from f),
q as materialized (select r, kind, ord, (stop - size)::bigint as start, stop::bigint as stop, token from p where counts),
cand as (select * from q where kind = 'random' and not exists (select 1 from q b where b.r = q.r and b.ord < 4 and b.start < q.stop and q.start < b.stop)),
tok as (select c.*, rtrim(token, '=') as core, (select min(e) from enc where translate(rtrim(token, '='), alphabet, '') = '') as e from cand c),
chars as (select t.*, alphabet, length(alphabet)::double as k, length(core)::double as n,
    list_transform(string_split(core, ''), lambda x: 2 * instr(alphabet, x) - 1 - length(alphabet)) as u from tok t join enc using (e)),
stats as (select r, ord, kind, start, stop, e, k, n, list_sum(list_transform(list_distinct(u), lambda a: len(list_filter(u, lambda x: x = a)) * (len(list_filter(u, lambda x: x = a)) - 1) / 2)) as pairs,
    list_sum(list_transform(range(1, len(u)), lambda i: ((u[i] > 0) <> (u[i + 1] > 0))::bigint))::double as turned,
    list_sum(list_transform(range(1, len(u)), lambda i: (u[i] * u[i + 1])::bigint))::double as product from chars),
t as (select s.*, floor(log2(n)) as cls,
    (cbrt((k / n * (2 * pairs + n) - n) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) <= {one!r}
      and abs((2 * turned - (n - 1)) / sqrt(n - 1)) <= {two!r} and abs(3 * product / ((k * k - 1) * sqrt(n - 1))) <= {two!r} as even,
    ((n * (n - 1) / 2 * s2 - pairs) / sqrt(greatest(n * (n - 1) / 2 * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2), 1))
      + (turned - (n - 1) * (2 * low * (1 - low))) / sqrt(greatest((n - 1) * (2 * low * (1 - low)) * (1 - 2 * low * (1 - low))
          + 2 * (n - 2) * (low * (1 - low) - (2 * low * (1 - low)) ** 2), 1))) / {sqrt(2)!r} as unlike from stats s left join law using (e)),
z as (select *, least(greatest(floor(16 * unlike), 0), 160)::bigint as score from t),
cut as (select cls, min(score) as cutoff from (select cls, score, count(*) over (partition by cls order by score desc) as above, count(*) over (partition by cls) as tests from z)
  where tests * ([{tails}])[score + 1] <= {false_share!r} * above group by cls),
spans as (select r, ord, kind, start, stop from q where ord < 4 union all select r, ord, kind, start, stop from z join cut using (cls) where even and score >= cutoff),
o as (select r, count(*) filter (ord = 1) as n_assign, count(*) filter (ord = 2) as n_access, count(*) filter (ord = 3) as n_hex, count(*) filter (ord = 4) as n_random,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < 4) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans from spans group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_random, 0) as n_random
from d left join o using (r)
"""


ORACLES = {
    "op4_adaptive_quality": adaptive_quality(),
    "op5_capped_water_filling": water_filling(),
    "op7_multi_order_jaccard": JACCARD,
    "op8_warc_segments": WARC,
    "op10_interval_expansion": REPEATS,
    "op11_position_table_resampling": resampling(),
    "op13_randomness_battery": randomness(),
}
