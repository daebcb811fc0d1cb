"""The corpus queries that SQL can express, as DuckDB SQL over whole tables.

Left out, and tested against brute force instead: op1 and op7 (learned from the
corpus), op2 (parsing), op5 and op10 (no such SQL functions), op8 (its order is
Spark's hash), and the pipeline, which holds op8 and op10.
"""

from __future__ import annotations

from cellwright.llm import licences, quality

_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), [])"


def neardup() -> str:
    lower = "translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    return f"""
with recursive w as (select doc_id, {_WORDS.format(lower)} ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+3], ' ') s from (select doc_id, ws, unnest(range(1, greatest(len(ws)-3, 1)+1)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100*c >= 80*(x.n + y.n - c)),
r(v, m) as (select doc_id, doc_id from documents union select case when e.a = r.v then e.b else e.a end, r.m from r join e on e.a = r.v or e.b = r.v),
c as (select v, min(m) m from r group by 1)
select doc_id, coalesce(n.n, 0) n_shingles, c.m component_id, doc_id = c.m kept from documents join c on c.v = doc_id left join n using (doc_id)"""


def substrings() -> str:
    return f"""
with w as (select doc_id, {_WORDS.format('text')} ws from documents),
k as (select doc_id, i, array_to_string(ws[i:i+34], ' ') s from (select doc_id, ws, unnest(range(1, len(ws)-33)) i from w where len(ws) >= 35)),
twice as (select s from k group by s having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i+35)) p from k join twice using (s)),
each as (select doc_id, unnest(ws) x, unnest(range(1, len(ws)+1)) p from w),
kept as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from each anti join gone using (doc_id, p) group by 1)
select doc_id, len(ws) n_words, len(ws) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)"""


def quality_rules() -> str:
    rules, risk, delta = quality.RULES, quality.MAX_FALSE_REJECTION, quality.DELTA
    levels = range(quality.LEVELS)
    sums = ", ".join("count(*) filter (" + " or ".join(f"{e} > {cs[j]}" for e, cs in rules.values()) + f") k{j}" for j in levels)
    p, q = f"ln({risk!r}::double)", f"ln(1 - {risk!r}::double)"
    tail = (f"case when {{0}} >= n * {risk!r}::double then 1.0 else list_sum(list_transform(range(0, {{0}}+1),"
            f" lambda j: exp(lgamma(n+1)-lgamma(j+1)-lgamma(n-j+1) + j*{p} + (n-j)*{q}))) end")
    level = "case " + " ".join(f"when {tail.format(f'k{j}')} > error then {j}" for j in levels) + f" else {quality.LEVELS} end"
    cuts = ", ".join(f"([{', '.join(f'{c!r}::double' for c in cs)}])[level] cut_{r}" for r, (_, cs) in rules.items())
    passes = " and ".join(f"not coalesce({e} > cut_{r}, false)" for r, (e, _) in rules.items())
    return f"""
with w as (select doc_id, coalesce(text, '') t, lang, {_WORDS.format('text')} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from documents),
k as (select doc_id, i, array_to_string(ws[i:i+7], ' ') s from (select doc_id, ws, unnest(range(1, len(ws)-6)) i from w where len(ws) >= 8)),
twice as (select doc_id, s from k group by all having count(*) > 1),
cov as (select doc_id, count(distinct p) n_repeat_words from (select doc_id, unnest(range(i, i+8)) p from k join twice using (doc_id, s)) group by 1),
f as (select doc_id, lang, len(ws) n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls) n_lines,
 (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::bigint n_upper from w left join cov using (doc_id)),
g as (select *, n_words < 20 or 100*n_repeat_words > 30*n_words base_failed from f),
c as (select lang, count(*) n, {sums} from g where not base_failed and doc_id in (select doc_id from labels where quality = 1) group by lang),
m as (select coalesce({delta!r}::double / max(r), 0) error from (select n, row_number() over (order by n desc) r from c) where pow(1 - {risk!r}::double, n) <= {delta!r}::double / r),
d as (select lang, {cuts} from (select lang, {level} as level from c, m) where level > 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {passes} kept from g left join d on g.lang is not distinct from d.lang"""


def licence_scan() -> str:
    values = ", ".join(f"('{anchor}', '{name}', {n}, {place}, [{', '.join(repr(x) for x in grams)}])" for anchor, name, n, place, grams in licences.prepared())
    few = licences.MIN_DICE / (2 - licences.MIN_DICE)
    return f"""
with t(anchor, licence, n, f, grams) as (values {values}),
w as (select doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') ws from documents),
a as (select doc_id, ws, x, p from (select doc_id, ws, unnest(ws) x, unnest(range(0, len(ws))) p from w) where x in (select anchor from t)),
c as (select doc_id, p, licence, n, grams, greatest(p-f, 0) pos, list_distinct(list_transform(range(greatest(p-f, 0)+1, least(p-f+n, len(ws))), lambda i: ws[i] || ' ' || ws[i+1])) b,
 least(p-f+n, len(ws)) - greatest(p-f, 0) size from a join t on x = anchor),
s as (select doc_id, p, licence, case when size >= 2 and size-1 >= {few!r} * len(grams) then 2.0::double * len(list_intersect(b, grams)) / (len(b) + len(grams)) else 0::double end dice, n, pos from c),
best as (select doc_id, p, max(row(dice, n, licence, pos)) m from s group by 1, 2),
found as (select distinct doc_id, m[1]::double dice, m[2]::int n, m[3]::varchar licence, m[4]::int pos from best where m[1] >= {licences.MIN_DICE!r})
select d.doc_id, count(licence) n_found, coalesce(string_agg(distinct licence, ',' order by licence), '') licences, round(coalesce(max(dice), 0::double), 6) best_dice from documents d left join found using (doc_id) group by 1"""
