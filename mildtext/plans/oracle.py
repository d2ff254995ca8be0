"""The registered queries in SQL over the raw tables, written independently of the Spark plans.

Common table expressions are kept once in ``PARTS`` and each query takes those it names.
"""

from __future__ import annotations

import re

from mildtext.functions.terms import BUILTIN_TERMS
from mildtext.operators import kmeans, vectors
from mildtext.operators.bootstrap import DRAWN, poisson_bounds
from mildtext.plans import views as vw
from mildtext.plans.queries import (
    BOOTSTRAP_N, CLUSTERS, EVAL, FEW_SHOT_FITS, FEW_SHOT_STEPS, PREP, SAMPLE, STEP_CLUSTERS, STEPS,
)

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def trigrams(key: str, text: str, source: str) -> str:
    """Signed trigram counts: ``key``, ``place``, ``n``; rows for places with trigrams only."""
    number = f"(((unicode(c[i])::bigint * {vectors.BASE} + unicode(c[i + 1])) % {vectors.PRIME}) * {vectors.BASE} + unicode(c[i + 2])) % {vectors.PRIME}"
    return f"""(select {key}, h % {vectors.WIDTH} place, sum(1 - 2 * (h // {vectors.WIDTH} % 2))::bigint n from (select {key}, {number} h from
  (select {key}, c, unnest(range(1, len(c) - 1)) i from (select {key}, string_split(' ' || {collapse(f"lower({text})")} || ' ', '') c from {source}))) group by all)"""


def whole_vectors(key: str, text: str, source: str, out: str) -> str:
    """CTE ``out``: ``key`` and ``v``, the unit vector in whole steps as a list."""
    return f"""
{out}_n as materialized {trigrams(key, text, source)},
{out} as materialized (select {key}, list(floor({vectors.SCALE} * coalesce(n, 0) / (case when s > 0 then sqrt(s) else 1.0 end))::double order by place) v from
  (select t.{key}, g.place, n, sum(coalesce(n, 0) * coalesce(n, 0)) over (partition by t.{key})::double s
   from (select {key} from {source}) t, (select unnest(range({vectors.WIDTH})) place) g left join {out}_n n on n.{key} = t.{key} and n.place = g.place) group by {key})"""


def clusters(fits: kmeans.Fits, id_kind: str = "bigint") -> str:
    """CTEs from ``pts`` (id, grp, h, v) to ``placed``: grp, k, id, cl, d by the centres of the best fit, and ``best``: grp, k, cl, v."""
    def dist(a: str, b: str) -> str:
        return f"(list_dot_product({a}, {a}) + list_dot_product({b}, {b}) - 2 * list_dot_product({a}, {b}))"

    def nearest(name: str, centres: str, number: str) -> str:
        return f"""
{name} as materialized (select p.grp, c.f, c.k, p.id, p.h, c.{number}, {dist("p.v", "c.v")} d from pts p join {centres} c using (grp)
  qualify row_number() over (partition by p.grp, c.f, p.id order by d, c.{number}) = 1)"""

    turns = range(fits.rounds + 1)
    rows = ", ".join(f"({n}, {k}, {', '.join(str(fits.factor(n, t)) for t in turns)})" for n, k in enumerate(fits.all()))
    out = f"""
fits(f, k, {", ".join(f"a{t}" for t in turns)}) as (values {rows}),
t0 as materialized (select grp, f, k, 0 j, v from pts, fits
  qualify row_number() over (partition by grp, f order by h % {kmeans.PRIME} * a0 % {kmeans.PRIME} + 1, h) = 1),"""
    for t in turns[1:]:
        out += nearest(f"n{t}", f"t{t - 1}", "j") + f""",
t{t} as materialized (select * from t{t - 1} union all select grp, f, k, 1 + {t - 1} * k + r, v from
  (select n.grp, n.f, n.k, p.v, row_number() over (partition by n.grp, n.f order by (n.h % {kmeans.PRIME} * a{t} % {kmeans.PRIME} + 1) / n.d, n.h) r
   from n{t} n join fits using (f) join pts p using (grp, id) where n.d > 0) where r <= k),"""
    last = turns[-1]
    out += nearest("weighed", f"t{last}", "j") + f""",
cand as materialized (select grp, f, k, j, v, coalesce(w, 0)::double w from t{last} left join (select grp, f, j, count(*) w from weighed group by all) using (grp, f, j)),
pick as (
  select 1 i, c.grp, c.f, c.k, c.j, c.w, {dist("c.v", "o.v")} sq, o.j picked from cand c join
    (select * from cand qualify row_number() over (partition by grp, f order by w desc, j) = 1) o using (grp, f)
  union all
  select i + 1, s.grp, s.f, s.k, s.j, s.w, least(s.sq, {dist("c.v", "o.v")}), o.j from
    (select *, first_value(j) over (partition by grp, f order by w * sq desc, j) nxt, max(w * sq) over (partition by grp, f) m from pick where i < k) s
    join cand c on c.grp = s.grp and c.f = s.f and c.j = s.j join cand o on o.grp = s.grp and o.f = s.f and o.j = s.nxt where m > 0),
c0 as materialized (select p.grp, p.f, p.k, i - 1 cl, c.v from (select distinct i, grp, f, k, picked from pick) p join cand c on c.grp = p.grp and c.f = p.f and c.j = p.picked),"""
    for n in range(fits.steps):
        out += nearest(f"a{n}", f"c{n}", "cl") + f""",
m{n} as (select grp, f, cl, list(floor(x / n) order by d) v from (select grp, f, cl, d, sum(x) x, count(*) n from
  (select a.grp, f, cl, unnest(p.v) x, generate_subscripts(p.v, 1) d from a{n} a join pts p using (grp, id)) group by all) group by all),
c{n + 1} as materialized (select grp, f, k, cl, coalesce(m{n}.v, c{n}.v) v from c{n} left join m{n} using (grp, f, cl)),"""
    return out + nearest("placed_all", f"c{fits.steps}", "cl") + f""",
won as (select grp, k, f from (select grp, k, f, sum(d) cost from placed_all group by all) qualify row_number() over (partition by grp, k order by cost, f) = 1),
placed as (select * from placed_all join won using (grp, k, f)),
best as materialized (select c.* from c{fits.steps} c join won using (grp, k, f)),
near as materialized (select grp, k, cl, id, {dist("p.v", "c.v")} d, row_number() over (partition by grp, k, cl order by d, h) place
  from pts p join best c using (grp) qualify place <= k),
took as (select grp, k, -1::bigint cl, []::{id_kind}[] taken from (select distinct grp, k from best)
  union all select grp, k, n.cl, list_append(taken, id) from took join near n using (grp, k) where n.cl = took.cl + 1 and not list_contains(taken, id)
    qualify row_number() over (partition by grp, k order by place) = 1),
chosen as (select grp, k, unnest(taken) id from took qualify row_number() over (partition by grp, k order by took.cl desc) = 1)"""


def clean(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def values(terms: dict) -> str:
    rows = sorted({(lang, t) for lang, group in terms.items() for t in group})
    return ", ".join(f"('{lang}', '{term}')" for lang, term in rows)


def words_13a(x: str) -> str:
    t = f"regexp_replace({x}, '{WS}+$', '')"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        t = f"replace({t}, {old}, {new})"
    t = f"(' ' || {t} || ' ')"
    for pattern, new in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "),
                         (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return words(t)


def deleted(source: str, key: str, lexicon: str, match: str, out: str) -> str:
    """CTEs ``<out>_tok``, ``<out>_hit`` and ``<out>``: key, prediction; by a scan of the lexicon."""
    if match == "exact":
        rule = "v.c = l.term"
    else:
        rule = ("(v.c = l.term or (length(v.c) >= 4 and length(l.term) >= 4 "
                "and (starts_with(v.c, l.term) or starts_with(l.term, v.c))))")
    return f"""
{out}_tok as (select k, lang, unnest(ws) t, generate_subscripts(ws, 1) p
  from (select {key} k, lang, {words('text')} ws from {source})),
{out}_hit as (select distinct v.lang, v.c
  from (select distinct lang, {clean('t')} c from {out}_tok) v join {lexicon} l on v.lang = l.lang and {rule}),
{out} as (select s.{key}, s.lang,
    coalesce(nullif(string_agg(t.t, ' ' order by t.p) filter (h.c is null), ''), s.text) prediction
  from {source} s left join {out}_tok t on t.k = s.{key}
  left join {out}_hit h on h.lang = t.lang and h.c = {clean('t.t')}
  group by s.{key}, s.lang, s.text)"""


def flagged_counts(source: str, key: str, text: str, lexicon: str, match: str, out: str) -> str:
    """CTE ``<out>``: key, n_tokens, n_flagged, tox."""
    rule = ("v.c = l.term" if match == "exact" else
            "(v.c = l.term or (length(v.c) >= 4 and length(l.term) >= 4 "
            "and (starts_with(v.c, l.term) or starts_with(l.term, v.c))))")
    return f"""
{out}_tok as (select {key}, lang, unnest({words(text)}) t from {source}),
{out}_hit as (select distinct v.lang, v.c
  from (select distinct lang, {clean('t')} c from {out}_tok) v join {lexicon} l on v.lang = l.lang and {rule}),
{out}_cnt as (select {key}, count(*) n_tokens, count(h.c) n_flagged
  from {out}_tok t left join {out}_hit h on h.lang = t.lang and h.c = {clean('t.t')} group by {key}),
{out} as (select s.*, coalesce(n_tokens, 0) n_tokens, coalesce(n_flagged, 0) n_flagged,
    coalesce(n_flagged, 0) / (coalesce(n_flagged, 0) + 1.0::double) tox
  from {source} s left join {out}_cnt c using ({key}))"""


def hashed(words_sql: str) -> str:
    return (f"list_transform({words_sql}, lambda w: (('0x' || substr(md5(w), 1, 8))::bigint % (32000 - 2)) + 2)")


def cut_ids(text: str) -> str:
    return f"list_append(list_slice({hashed(words(text))}, 1, 127), 1)"


def padded(ids: str, pad: str = "0") -> str:
    return f"array_to_string(list_resize({ids}, 128, {pad}), ',')"


def mask(ids: str) -> str:
    return f"array_to_string(list_resize(list_transform({ids}, lambda x: 1), 128, 0), ',')"


def split_rank(source: str, ids: str, order: str) -> str:
    """Rank in the seeded order by a plain window, and the counts of each split."""
    ratios = {**PREP.split_ratios}
    val = " ".join(f"when '{k}' then {v[0]}::double" for k, v in ratios.items())
    test = " ".join(f"when '{k}' then {v[1]}::double" for k, v in ratios.items())
    d = PREP.default_ratios
    return f"""
ranked as (select *, row_number() over (partition by lang order by md5(concat_ws('|', '42', {ids})), {order}) rk,
    count(*) over (partition by lang) n from {source}),
sized as (select *, greatest(1, floor(n * (case lang {val} else {d[0]}::double end)))::bigint n_val,
    floor(n * (case lang {test} else {d[1]}::double end))::bigint n_test from ranked),
splitted as (select * exclude (rk, n, n_val, n_test), case when rk <= n - n_val - n_test then 'train'
    when rk <= n - n_test then 'val' else 'test' end split from sized)"""


def gram_stats(source: str, key: str) -> str:
    """CTE ``gram_stats``: per row, kind and order the overlap of two lists of units."""
    leads = ", ".join(f"lead(x, {i}) over w x{i}" for i in range(1, 6))
    cases = []
    for n in range(1, 7):
        rest = "".join(f" || sep || x{i}" for i in range(1, n))
        last = "x" if n == 1 else f"x{n - 1}"
        cases.append(f"select {key}, kind, is_left, {n} n, x{rest} g from gram_shift where {n} <= orders and {last} is not null")
    return f"""
gram_pos as (select {key}, kind, orders, is_left, unnest(u) x, generate_subscripts(u, 1) p from {source}),
gram_shift as (select *, case when kind = 'char' then '' else ' ' end sep, {leads} from gram_pos
  window w as (partition by {key}, kind, is_left order by p)),
gram_rows as ({" union all ".join(cases)}),
gram_cnt as (select {key}, kind, n, g, count(*) filter (is_left) a, count(*) filter (not is_left) b
  from gram_rows group by all),
gram_stats as (select {key}, kind, n, sum(a) a, sum(b) b, sum(least(a, b)) m, sum(a * b) ab, sum(a * a) aa,
    sum(b * b) bb from gram_cnt group by all)"""


POISSON = " ".join(f"when x < '{bound}' then {k}" for k, bound in enumerate(poisson_bounds()))


def bootstrap(source: str, keys: str, by: str, cols: list[str], out_name: str) -> str:
    """CTE ``out_name``: group columns and <col>_mean/lower/upper; small groups by row draws, others by Poisson counts."""
    means = ", ".join(f"sum(w * {c}) / sum(w) {c}" for c in cols)
    texts = ", ".join(f"{k}::varchar" for k in keys.split(", "))
    both = ", ".join(dict.fromkeys([*by.split(", "), *keys.split(", ")]))
    low, high = (1 - EVAL.bootstrap_ci) / 2, 1 - (1 - EVAL.bootstrap_ci) / 2
    bounds = ", ".join(f"quantile_cont({c}, {low}) {c}_lo, quantile_cont({c}, {high}) {c}_hi" for c in cols)
    centre = ", ".join(f"avg({c}) {c}_avg" for c in cols)
    out = ", ".join(
        f"round({c}_avg, 4) {c}_ci_mean, round(coalesce({c}_lo, {c}_avg), 4) {c}_ci_lower, "
        f"round(coalesce({c}_hi, {c}_avg), 4) {c}_ci_upper" for c in cols)
    return f"""
{out_name}_reps as (select unnest(range(0, {BOOTSTRAP_N})) rep),
{out_name}_src as materialized (select {both}, {', '.join(f'coalesce({c}, 0) {c}' for c in cols)}, count(*) over (partition by {by}) n_rows,
    row_number() over (partition by {by} order by {keys}) - 1 idx from {source}),
{out_name}_small as (select {by}, r.rep, {', '.join(f'sum({c}) / any_value(n_rows) {c}' for c in cols)} from
  (select {by}, rep, (('0x' || substr(md5(concat_ws('|', '42', {by}, (t // 4)::varchar)), (8 * (t % 4) + 1)::bigint, 8))::bigint * n_rows) >> 32 idx
   from (select {by}, n_rows, rep, rep * n_rows + j t from (select {by}, n_rows, rep, unnest(range(n_rows)) j from
     (select distinct {by}, n_rows from {out_name}_src where n_rows <= {DRAWN}), {out_name}_reps))) r
  join {out_name}_src using ({by}, idx) group by {by}, r.rep),
{out_name}_draws as (select {by}, {', '.join(cols)}, rep,
    substr(md5(concat_ws('|', '42', {texts}, (rep // 4)::varchar)), (8 * (rep % 4) + 1)::bigint, 8) x
  from {out_name}_src, {out_name}_reps where n_rows > {DRAWN}),
{out_name}_weights as (select *, case {POISSON} else {len(poisson_bounds())} end w from {out_name}_draws),
{out_name}_means as (select {by}, rep, {means} from {out_name}_weights where w > 0 group by {by}, rep
  union all select {by}, rep, {', '.join(cols)} from {out_name}_small),
{out_name} as (select {by}, {out}
  from (select {by}, {centre} from {source} group by {by}) left join
    (select {by}, {bounds} from {out_name}_means group by {by}) using ({by}))"""


def union_langs(terms: tuple) -> dict:
    return vw.per_language(tuple(terms))


def builtin_for_documents() -> dict:
    """Every language of the tables: its own list, or all lists."""
    everything = sorted({t for group in BUILTIN_TERMS.values() for t in group})
    return {lang: BUILTIN_TERMS.get(lang, everything) for lang in vw.LANGS}


def series_lexicon() -> str:
    rows = [f"('{m}_{k}', '{m}', {k}, '{t}')" for m in vw.SERIES_METHODS for k in vw.SERIES_SIZES
            for t in vw.SERIES_TERMS[:k]]
    return ", ".join(rows)


WORD_SUMS = ", ".join(
    f"coalesce(sum({s}) filter (kind = 'word' and n = {n}), 0)::double w{n}{s}" for n in range(1, 5) for s in "abm")
CHAR_SUMS = ", ".join(
    f"coalesce(sum({'case when b > 0 then a else 0 end' if s == 'a' else s}) filter (kind = 'char' and n = {n}), 0)"
    f"::double c{n}{s}" for n in range(1, 7) for s in "abm")


def bleu_sql() -> str:
    reached = {n: " and ".join(f"w{i}a > 0" for i in range(1, n + 1)) for n in range(1, 5)}
    zeros = {n: " + ".join(f"(case when {reached[i]} and w{i}m = 0 then 1 else 0 end)" for i in range(1, n + 1))
             for n in range(1, 5)}
    logs = " + ".join(
        f"(case when {reached[n]} then ln(case when w{n}m > 0 then 100.0::double * w{n}m / w{n}a "
        f"else 100.0::double / (power(2.0::double, {zeros[n]}) * w{n}a) end) else 0 end)" for n in range(1, 5))
    used = " + ".join(f"(case when {reached[n]} then 1 else 0 end)" for n in range(1, 5))
    return (f"case when w1m + w2m + w3m + w4m = 0 then 0.0::double else "
            f"(case when w1a < w1b then exp(1 - w1b / w1a) else 1.0::double end) * exp(({logs}) / ({used})) end")


def chrf_sql() -> str:
    both = {n: f"c{n}a > 0 and c{n}b > 0" for n in range(1, 7)}
    used = " + ".join(f"(case when {both[n]} then 1 else 0 end)" for n in both)
    p = " + ".join(f"(case when {both[n]} then c{n}m / c{n}a else 0 end)" for n in both)
    r = " + ".join(f"(case when {both[n]} then c{n}m / c{n}b else 0 end)" for n in both)
    return (f"(select coalesce(100.0::double * 5 * pr * rc / nullif(4 * pr + rc, 0), 0) from "
            f"(select ({p}) / nullif({used}, 0) pr, ({r}) / nullif({used}, 0) rc))")


def summary_columns(fluency: bool = True) -> str:
    parts = """count(*) n_samples, round(avg(tox), 4) toxicity_mean, round(avg(sta), 4) sta,
    round(avg(sta) * 100, 2) toxicity_pct_below_threshold, round(avg(sim), 4) similarity_mean,
    round(avg(sim_ok) * 100, 2) similarity_pct_above_threshold, round(avg(j2), 4) j2_score"""
    if fluency:
        parts += """, round(avg(ppl), 2) fluency_ppl_mean, round(avg(fl), 4) fluency_norm_mean,
    case when count(fl) = count(*) then round(avg(j3), 4) end j3_score"""
    return parts


PARTS: dict[str, str] = {
    # pairs
    "doc_pairs": """doc_pairs as (select a.doc_id pair_id, a.lang, a.text toxic_sentence, coalesce(b.text, '') neutral_sentence
  from documents a left join documents b on b.doc_id = a.doc_id + 1)""",
    "conv_pairs": """conv_pairs as (select u.conv_id * 1000000000 + u.turn pair_id, 'en' lang, u.text original,
    a.text converted from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')""",
    "raw_sources": f"""raw_sources as (
  select 'converted' source, 0 source_rank, pair_id, lang, {strip('original')} toxic, {strip('converted')} neutral
    from conv_pairs
  union all select 'parallel', 1, pair_id, lang, {strip('toxic_sentence')}, {strip('neutral_sentence')} from doc_pairs
  union all select 'extra', 2, pair_id, lang, {strip('toxic_sentence')}, {strip('neutral_sentence')} from doc_pairs
    where lang = 'es'
  union all select 'unanswered', 3, conv_id * 1000000000 + turn, 'en', {strip('text')}, '' from conversations
    where role = 'system')""",
    "all_sources": """all_sources as (select * from raw_sources
  where source <> 'unanswered' and toxic <> '' and neutral <> '')""",
    "counted": f"""counted as (select *, len({words('toxic')}) nt, len({words('neutral')}) nn,
    md5(toxic || '|||' || neutral) pair_hash from raw_sources)""",
    "ratioed": """ratioed as (select *, greatest(nt, nn) / greatest(least(nt, nn), 1)::double ratio,
    nt > 0 and nn > 0 filled from counted)""",
    "cleaned": """cleaned as (select * from ratioed where filled and ratio <= 3.0
  qualify row_number() over (partition by lang, pair_hash order by source_rank, pair_id) = 1)""",
    "parallel": f"""parallel as (select pair_id, lang, {strip('toxic_sentence')} toxic,
    {strip('neutral_sentence')} neutral from doc_pairs)""",
    "parallel_filled": "parallel_filled as (select * from parallel where toxic <> '' and neutral <> '')",
    # lexicons
    "lex_terms": f"lex_terms as (select * from (values {values(vw.per_language(vw.TERMS))}) v(lang, term))",
    "lex_wider": f"lex_wider as (select * from (values {values(vw.per_language(vw.WIDER_TERMS))}) v(lang, term))",
    "lex_judge": f"lex_judge as (select * from (values {values(vw.per_language(vw.JUDGE_TERMS))}) v(lang, term))",
    "lex_builtin": f"lex_builtin as (select * from (values {values(BUILTIN_TERMS)}) v(lang, term))",
    "lex_documents": f"lex_documents as (select * from (values {values(builtin_for_documents())}) v(lang, term))",
    "bench_words": f"bench_words as (select 'en' lang, unnest({words('text')}) word from benchmark)",
    "lex_bench": f"lex_bench as (select distinct lang, lower({strip('word')}) term from bench_words)",
    "lex_large": "lex_large as (select * from lex_bench union select * from lex_judge)",
    # tokens
    "vocab": f"""vocab as (select lang, token, count(distinct doc_id) n_texts from
    (select doc_id, lang, {clean('t')} token from (select doc_id, lang, unnest({words('text')}) t from documents))
  where token <> '' group by lang, token)""",
    "del_exact": deleted("documents", "doc_id", "lex_terms", "exact", "del_exact"),
    "del_prefix": deleted("documents", "doc_id", "lex_judge", "prefix", "del_prefix"),
    "del_builtin": deleted("documents", "doc_id", "lex_documents", "prefix", "del_builtin"),
    "lex_augmented": f"""lex_augmented as (select * from lex_documents
  union select * from (values {values(vw.AUGMENTED_TERMS)}) v(lang, term))""",
    "del_augmented": deleted("documents", "doc_id", "lex_augmented", "prefix", "del_augmented"),
    "del_large": deleted("documents", "doc_id", "lex_large", "prefix", "del_large"),
    "doc_tox": flagged_counts("documents", "doc_id", "text", "lex_terms", "exact", "doc_tox"),
    "doc_judged": flagged_counts("documents", "doc_id", "text", "lex_judge", "prefix", "doc_judged"),
    # predictions
    "toxic_inputs": """toxic_inputs as (select doc_id row_id, lang, text from documents
  where doc_id in (select doc_id from labels where toxic = 1))""",
    "p_exact": deleted("toxic_inputs", "row_id", "lex_terms", "exact", "p_exact"),
    "p_prefix": deleted("toxic_inputs", "row_id", "lex_wider", "prefix", "p_prefix"),
    "p_neutral": deleted("toxic_inputs", "row_id", "lex_judge", "prefix", "p_neutral"),
    "rewrites": """rewrites as (select i.row_id, i.lang, i.text toxic, n.prediction neutral, e.experiment,
    case e.experiment when 'identity' then i.text when 'delete_exact' then x.prediction else f.prediction end prediction
  from toxic_inputs i join p_neutral n using (row_id) join p_exact x using (row_id) join p_prefix f using (row_id),
    (values ('identity'), ('delete_exact'), ('delete_prefix')) e(experiment))""",
    "keyed": "keyed as (select *, experiment || '/' || row_id rk from rewrites)",
    "series_lex": f"series_lex as (select * from (values {series_lexicon()}) v(experiment, method, size, term))",
    "series_tok": f"""series_tok as (select row_id, unnest(ws) t, generate_subscripts(ws, 1) p
  from (select row_id, {words('text')} ws from toxic_inputs))""",
    "series_hit": f"""series_hit as (select distinct l.experiment, v.c
  from (select distinct {clean('t')} c from series_tok) v join series_lex l on v.c = l.term or (l.method = 'prefix'
    and length(v.c) >= 4 and length(l.term) >= 4 and (starts_with(v.c, l.term) or starts_with(l.term, v.c))))""",
    "series_rewrites": f"""series_rewrites as (
  select i.row_id, i.lang, i.text toxic, e.experiment,
    coalesce(nullif(string_agg(t.t, ' ' order by t.p) filter (h.c is null), ''), i.text) prediction
  from toxic_inputs i cross join (select distinct experiment from series_lex) e
  left join series_tok t using (row_id)
  left join series_hit h on h.experiment = e.experiment and h.c = {clean('t.t')}
  group by i.row_id, i.lang, i.text, e.experiment
  union all select row_id, lang, text, 'identity', text from toxic_inputs)""",
    "series_keyed": "series_keyed as (select *, experiment || '/' || row_id rk from series_rewrites)",
    # scores
    "tox_rows": flagged_counts("keyed", "rk", "prediction", "lex_judge", "prefix", "tox_rows"),
    "units": f"""units as (
  select rk, 'term' kind, 1 orders, true is_left, {words('lower(toxic)')} u from keyed
  union all select rk, 'term', 1, false, {words('lower(prediction)')} from keyed
  union all select rk, 'word', 4, true, {words_13a('prediction')} from keyed
  union all select rk, 'word', 4, false, {words_13a('neutral')} from keyed
  union all select rk, 'char', 6, true, string_split(regexp_replace(prediction, '{WS}+', '', 'g'), '') from keyed
  union all select rk, 'char', 6, false, string_split(regexp_replace(neutral, '{WS}+', '', 'g'), '') from keyed)""",
    "gram_stats": gram_stats("units", "rk"),
    "sim_rows": """sim_rows as (select rk, case when aa > 0 and bb > 0
    then ab / (sqrt(aa::double) * sqrt(bb::double)) else 0.0 end sim from gram_stats where kind = 'term')""",
    "corpus": f"""corpus as (select experiment, lang, {WORD_SUMS}, {CHAR_SUMS}
  from gram_stats join (select rk, experiment, lang from keyed) using (rk) group by experiment, lang)""",
    "model_pairs": f"""model_pairs as (select lang, w1, w2, count(*) c12 from
    (select lang, unnest(list_prepend('<s>', ws[:-2])) w1, unnest(ws) w2 from
      (select lang, {words('lower(text)')} ws from documents) where len(ws) > 0) group by all)""",
    "model_ctx": "model_ctx as (select lang, w1, sum(c12) c1 from model_pairs group by all)",
    "model_size": "model_size as (select lang, count(distinct w2) v from model_pairs group by all)",
    "doc_ppl": f"""doc_ppl as (select d.doc_id, exp(-avg(ln((coalesce(c12, 0) + 0.1::double)
      / (coalesce(c1, 0) + 0.1::double * v)))) ppl from
    (select doc_id, lang, unnest(list_prepend('<s>', ws[:-2])) w1, unnest(ws) w2 from
      (select doc_id, lang, {words('lower(text)')} ws from documents) where len(ws) > 0) d
  left join model_pairs p on p.lang = d.lang and p.w1 = d.w1 and p.w2 = d.w2
  left join model_ctx c on c.lang = d.lang and c.w1 = d.w1
  left join model_size s on s.lang = d.lang group by d.doc_id)""",
    "ppl_rows": f"""ppl_rows as (select d.rk, exp(-avg(ln((coalesce(c12, 0) + 0.1::double)
      / (coalesce(c1, 0) + 0.1::double * v)))) ppl from
    (select rk, lang, unnest(list_prepend('<s>', ws[:-2])) w1, unnest(ws) w2 from
      (select rk, lang, {words('lower(prediction)')} ws from keyed) where len(ws) > 0) d
  left join model_pairs p on p.lang = d.lang and p.w1 = d.w1 and p.w2 = d.w2
  left join model_ctx c on c.lang = d.lang and c.w1 = d.w1
  left join model_size s on s.lang = d.lang group by d.rk)""",
    "scored": """scored as (select *, sta * sim j2, sta * sim * fl j3 from (
  select k.experiment, k.row_id, k.lang, k.rk, t.tox, s.sim, p.ppl, (t.tox < 0.5)::int::double sta,
    (s.sim > 0.75)::int::double sim_ok,
    case when p.ppl > 0 then greatest(0.0, 1 - ln(p.ppl) / ln(1000.0::double)) end fl
  from keyed k join tox_rows t using (rk) join sim_rows s using (rk) left join ppl_rows p using (rk)))""",
    "ci": bootstrap("scored", "experiment, row_id", "experiment, lang", ["tox", "sim", "j2"], "ci"),
    "series_tox": flagged_counts("series_keyed", "rk", "prediction", "lex_judge", "prefix", "series_tox"),
    "series_sim": f"""series_cnt as (select rk, g, count(*) filter (is_left) a, count(*) filter (not is_left) b from
    (select rk, true is_left, unnest({words('lower(toxic)')}) g from series_keyed
     union all select rk, false, unnest({words('lower(prediction)')}) from series_keyed) group by all),
series_sim as (select rk, sum(a * b) / (sqrt(sum(a * a)::double) * sqrt(sum(b * b)::double)) sim
  from series_cnt group by rk)""",
    "series": f"""series as (select experiment, lang, split_part(experiment, '_', 1) as "method",
    try_cast(split_part(experiment, '_', 2) as bigint) n_shots, {summary_columns(False)}
  from (select k.experiment, k.lang, t.tox, s.sim, (t.tox < 0.5)::int::double sta, (s.sim > 0.75)::int::double sim_ok,
      (t.tox < 0.5)::int::double * s.sim j2
    from series_keyed k join series_tox t using (rk) join series_sim s using (rk)) group by experiment, lang)""",
    "zero": """zero as (select s.* replace (m."method" as "method") from series s,
    (values ('exact'), ('prefix')) m("method") where experiment = 'identity')""",
    "few": "few as (select * from series where experiment <> 'identity')",
    "record": f"""record as (select experiment, lang, {summary_columns()} from scored group by experiment, lang)""",
    "bleu_chrf": f"""bleu_chrf as (select experiment, lang, {bleu_sql()} bleu, {chrf_sql()} chrf from corpus)""",
    "baseline": """baseline as (select experiment, lang, toxicity_mean, toxicity_pct_below_threshold, similarity_mean,
    j2_score, round(bleu, 2) bleu, round(chrf, 2) chrf from record join bleu_chrf using (experiment, lang))""",
    # vectors
    "dims": """dims as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) d
  from embeddings)""",
    "centres": "centres as (select label, d, avg(x) c from dims group by all)",
    "distances": """distances as (select vec_id, label, sqrt(sum((x - c) * (x - c))) dist
  from dims join centres using (label, d) group by all)""",
    "nearest": """nearest as (select label::bigint as label, vec_id, round(dist, 6) dist from distances
  qualify row_number() over (partition by label order by dist, vec_id) = 1)""",
}


def sql(body: str) -> str:
    """The body with the parts it names, and those they name, in order."""
    order = list(PARTS)
    wanted: set[str] = set()

    def visit(text: str, stop: int) -> None:
        for name in order[:stop]:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(PARTS[name], order.index(name))

    visit(body, len(order))
    used = [PARTS[name].strip() for name in order if name in wanted]
    return ("with " + ",\n".join(used) + "\n" if used else "") + body


def _noref() -> str:
    return """select r.*, null::double bleu, null::double chrf,
  tox_ci_mean toxicity_ci_mean, tox_ci_lower toxicity_ci_lower, tox_ci_upper toxicity_ci_upper,
  sim_ci_mean similarity_ci_mean, sim_ci_lower similarity_ci_lower, sim_ci_upper similarity_ci_upper,
  j2_ci_mean, j2_ci_lower, j2_ci_upper from record r join ci using (experiment, lang)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["load_pairs"] = """select pair_id, lang, 'parallel' source, 0 source_rank, toxic, neutral from parallel_filled
where lang in ('en', 'es')"""
    q["load_inputs"] = f"""select * from (select doc_id row_id, lang, {strip('text')} as text from documents
where lang in ('en', 'es')) where text <> ''"""
    q["normalize_pairs"] = "select * from all_sources where source in ('converted', 'extra')"
    q["normalize_lang"] = f"""select doc_id pair_id, lang, 'labelled' source, 0 source_rank, {strip('text')} toxic,
source neutral from documents where lang in ('de', 'es') and {strip('text')} <> '' and source <> ''"""
    q["union_sources"] = "select source, source_rank, pair_id, lang, md5(toxic || '|||' || neutral) pair_hash from all_sources"
    q["load_lexicon"] = "select * from lex_builtin union select * from lex_bench"
    q["lexicon_growth"] = """select lang, count(*) filter (b) n_before, count(*) n_after, count(*) filter (not b) n_added
from (select lang, term, bool_or(b) b from (select *, true b from lex_builtin union all select *, false from lex_bench)
group by lang, term) group by lang"""
    q["text_normalize"] = f"""select doc_id, {strip('text')} stripped, {collapse('text')} collapsed,
len({words('text')})::bigint n_words from documents"""
    q["token_clean"] = "select * from vocab"
    q["label_to_toxicity"] = """select doc_id, round(case doc_id % 6 when 0 then toxic * 0.8::double + 0.1
when 1 then 1 - (quality * 0.5::double + 0.2) when 2 then 1 - (quality * 0.5::double + 0.2)
when 3 then toxic * 0.8::double + 0.1 when 4 then toxic * 0.8::double + 0.1 else 0.5 end, 6) tox from labels"""
    q["length_ratio_filter"] = """select source, pair_id, nt n_toxic, nn n_neutral, round(ratio, 6) ratio
from ratioed where filled and ratio <= 3.0 and source <> 'unanswered'"""
    q["dedup_pairs"] = """select source, source_rank, pair_id, lang, md5(toxic || '|||' || neutral) pair_hash from all_sources
qualify row_number() over (partition by lang, md5(toxic || '|||' || neutral) order by source_rank, pair_id) = 1"""
    q["preprocess_pairs"] = "select source, pair_id, lang, toxic, neutral from cleaned"
    q["preprocess_funnel"] = """select lang, count(*) n_orig, count(*) filter (not filled) n_empty,
count(*) filter (filled and ratio > 3.0) n_length,
count(*) filter (filled and ratio <= 3.0) - count(distinct pair_hash) filter (filled and ratio <= 3.0) n_dup,
count(distinct pair_hash) filter (filled and ratio <= 3.0) n_final from ratioed group by lang"""
    by_id = split_rank("parallel_filled", "pair_id::varchar", "pair_id")
    q["split_pairs"] = f"with_ {by_id} select pair_id, lang, split from splitted"
    q["split_preview"] = f"""with_ {by_id} select lang, split, pair_id, substr(toxic, 1, 100) toxic_start,
substr(neutral, 1, 100) neutral_start from splitted
qualify row_number() over (partition by lang, split order by pair_id) = 1"""
    q["data_summary"] = f"""with_ {by_id} select lang, split, count(*) n, 'pairs' kind from splitted group by lang, split
union all select lang, 'test_noref', count(*), 'texts' from toxic_inputs group by lang"""
    q["random_sample"] = f"""select doc_id, lang from documents
qualify row_number() over (partition by lang order by md5(concat_ws('|', '42', doc_id::varchar)), doc_id) <= {SAMPLE}"""
    by_source = split_rank("cleaned_sources", "source_rank::varchar, pair_id::varchar", "source_rank, pair_id")
    q["prepare_pairs"] = f"""with_ cleaned_sources as (select * from cleaned where source <> 'unanswered'), {by_source}
select source, pair_id, lang, split, {padded(cut_ids("'detoxify: ' || toxic"))} input_ids,
len({cut_ids("'detoxify: ' || toxic")})::bigint n_ids, {padded(cut_ids('neutral'), '-100')} labels from splitted"""
    q["prepare_few_shot"] = f"""with_ cleaned_sources as (select * from cleaned where source <> 'unanswered'), {by_source}
select source, source_rank, pair_id, lang, n_shots from splitted, (values {', '.join(f'({n})' for n in PREP.few_shot_sizes)}) s(n_shots)
where split = 'train' and lang in ({', '.join(f"'{x}'" for x in PREP.target_langs)})
qualify row_number() over (partition by lang, n_shots order by md5(concat_ws('|', '42', source_rank::varchar, pair_id::varchar)),
source_rank, pair_id) <= n_shots"""
    q["tokenized_roundtrip"] = q["prepare_pairs"].replace(f"len({cut_ids("'detoxify: ' || toxic")})::bigint n_ids, ", "")
    held = (
        """
toxic_inputs as (select source_rank || '/' || pair_id row_id, lang, toxic as text, neutral given from splitted where split <> 'train'),"""
        + deleted("toxic_inputs", "row_id", "lex_judge", "prefix", "cut")
        + """,
keyed as (select row_id, lang, text toxic, given neutral, 'delete' experiment, prediction, row_id rk
  from toxic_inputs join cut using (row_id, lang)),""" + flagged_counts("keyed", "rk", "prediction", "lex_judge", "prefix", "tox_rows")
        + ",\n" + ",\n".join(PARTS[p].strip() for p in ("units", "gram_stats", "sim_rows", "corpus", "bleu_chrf"))
        + """ select experiment, lang, count(*) n_samples, round(avg(tox), 4) toxicity_mean,
round(avg((tox < 0.5)::int::double), 4) sta, round(avg(sim), 4) similarity_mean,
round(avg((tox < 0.5)::int::double * sim), 4) j2_score, round(any_value(bleu), 2) bleu, round(any_value(chrf), 2) chrf
from keyed join tox_rows t using (rk, experiment, lang) join sim_rows using (rk) join bleu_chrf using (experiment, lang) group by experiment, lang"""
    )
    for name in ("toxic_inputs", "keyed", "tox_rows", "units", "gram_pos", "gram_shift", "gram_rows", "gram_cnt", "gram_stats",
                 "sim_rows", "corpus", "bleu_chrf"):
        held = re.sub(rf"\b{name}\b", f"held_{name}", held)  # parts of these names read the toxic inputs
    q["detox_test_split"] = f"with_ cleaned_sources as (select * from cleaned where source <> 'unanswered'), {by_source}, {held}"
    q["tokenize_pairs"] = f"""select pair_id, {padded(cut_ids("'detoxify: ' || toxic"))} input_ids,
{mask(cut_ids("'detoxify: ' || toxic"))} attention_mask, {padded(cut_ids('neutral'), '-100')} labels from parallel_filled"""
    q["tokenize_inputs"] = f"""select row_id, {padded(cut_ids("'detoxify: ' || text"))} input_ids,
{mask(cut_ids("'detoxify: ' || text"))} attention_mask from toxic_inputs"""
    q["lexicon_semi_join"] = "select * from vocab v where exists (select 1 from lex_terms l where l.lang = v.lang and l.term = v.token)"
    q["lexicon_anti_join"] = "select * from vocab v where not exists (select 1 from lex_terms l where l.lang = v.lang and l.term = v.token)"
    q["lexicon_prefix_join"] = """select distinct v.lang, v.token from vocab v join lex_judge l on l.lang = v.lang
and (v.token = l.term or (length(v.token) >= 4 and length(l.term) >= 4
and (starts_with(v.token, l.term) or starts_with(l.term, v.token))))"""
    q["delete_exact"] = "select * from del_exact"
    q["delete_prefix"] = "select * from del_prefix"
    q["delete_builtin"] = "select * from del_builtin"
    q["delete_large_lexicon"] = "select * from del_large"
    q["delete_augmented"] = "select * from del_augmented"
    q["delete_baseline"] = "with_ " + deleted("as_inputs", "pair_id", "lex_judge", "prefix", "cut").replace(
        "cut_tok as", "as_inputs as (select pair_id, lang, toxic as text from parallel_filled),\ncut_tok as", 1
    ) + " select pair_id, lang, prediction from cut"
    q["identity_baseline"] = "select pair_id, toxic, neutral, toxic prediction from parallel_filled"
    q["rewrite_batch"] = "select * from del_exact"
    q["toxicity_lexicon"] = """select doc_id, n_tokens, n_flagged, round(coalesce(n_flagged / nullif(n_tokens, 0)::double, 0), 6) tox_ratio,
round(tox, 6) tox from doc_tox"""
    q["toxicity_model"] = "select doc_id, round(tox, 6) tox from doc_tox"
    q["cosine_pairs"] = """select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) sim
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"""
    q["similarity_counts"] = f"""select pair_id, round(case when sum(a * a) > 0 and sum(b * b) > 0 then sum(a * b)
/ (sqrt(sum(a * a)::double) * sqrt(sum(b * b)::double)) else 0.0 end, 6) sim from
(select pair_id, g, count(*) filter (is_left) a, count(*) filter (not is_left) b from
  (select pair_id, true is_left, unnest({words('lower(toxic)')}) g from parallel_filled
   union all select pair_id, false, unnest({words('lower(neutral)')}) from parallel_filled) group by all) group by pair_id"""
    q["bigram_perplexity"] = "select doc_id, round(ppl, 4) ppl from documents left join doc_ppl using (doc_id)"
    q["fluency_norm"] = """select doc_id, round(case when ppl > 0 then greatest(0.0, 1 - ln(ppl) / ln(1000.0::double)) end, 6) fl
from documents left join doc_ppl using (doc_id)"""
    q["join_predictions"] = "select row_id, lang, toxic as text, experiment, prediction from rewrites"
    q["score_rows"] = """select experiment, row_id, lang, round(tox, 6) tox, round(sim, 6) sim, round(ppl, 4) ppl,
round(fl, 6) fl, sta, sim_ok, round(j2, 6) j2, round(j3, 6) j3 from scored"""
    q["fluency_summary"] = "select experiment, lang, fluency_ppl_mean, fluency_norm_mean from record"
    q["j_scores"] = "select experiment, lang, j2_score, j3_score from record"
    q["corpus_bleu"] = "select experiment, lang, round(bleu, 6) bleu from bleu_chrf"
    q["corpus_chrf"] = "select experiment, lang, round(chrf, 6) chrf from bleu_chrf"
    q["bootstrap_ci"] = "with_ " + bootstrap("doc_judged", "doc_id", "lang", ["tox"], "tox_only") + " select * from tox_only"
    turns = f"(select conv_id, turn, len({words("coalesce(text, '')")})::double n from conversations)"
    q["bootstrap_small"] = "with_ " + bootstrap(turns, "conv_id, turn", "conv_id", ["n"], "turn_ci") + " select * from turn_ci"
    q["evaluate_noref"] = _noref()
    q["evaluate_ref"] = f"""select n.* exclude (bleu, chrf), round(b.bleu, 2) bleu, round(b.chrf, 2) chrf
from ({_noref()}) n join bleu_chrf b on b.experiment = n.experiment and b.lang = n.lang"""
    q["evaluate_by_experiment"] = """select experiment, lang, "method", n_shots, n_samples, toxicity_mean, sta,
toxicity_pct_below_threshold, similarity_mean, similarity_pct_above_threshold, j2_score from few"""
    q["toxicity_lr_checked"] = """select count(*) n_scored, count(*) n_in_range, true toxic_is_higher
from documents left join labels using (doc_id)"""
    steps = """c0 as (select rk cluster, d, x c from dims join (select vec_id, row_number() over (order by vec_id)::int - 1 rk
  from embeddings) using (vec_id) where rk < %d)""" % STEP_CLUSTERS
    for n in range(STEPS + 1):
        steps += f""",
a{n} as (select vec_id, cluster, sqrt(sum((x - c) * (x - c))) dist from dims join c{n} using (d) group by vec_id, cluster
  qualify row_number() over (partition by vec_id order by dist, cluster) = 1)"""
        if n < STEPS:
            steps += f""",
m{n} as (select cluster, d, avg(x) c from dims join a{n} using (vec_id) group by all),
c{n + 1} as (select cluster, d, coalesce(m{n}.c, c{n}.c) c from c{n} left join m{n} using (cluster, d))"""
    q["kmeans_steps"] = f"with_ {steps} select vec_id, cluster, round(dist, 4) dist from a{STEPS}"
    q["diversity_given"] = f"""with_ {steps}, near as (select vec_id from a{STEPS} qualify row_number() over
  (partition by cluster order by dist, vec_id) = 1) select * from near union all (select vec_id from embeddings
where vec_id not in (select vec_id from near) order by md5(concat_ws('|', '42', vec_id::varchar)), vec_id limit {SAMPLE - STEP_CLUSTERS})"""
    def digest(*ids: str) -> str:
        return f"('0x' || substr(md5(concat_ws('|', '42', {', '.join(f'{i}::varchar' for i in ids)})), 1, 15))::bigint"

    embedded = f"""pts as materialized (select vec_id id, '' grp, {digest("vec_id")} h,
  [floor({vectors.SCALE} * x::double) for x in embedding] v from embeddings where embedding is not null),"""
    q["kmeans_clusters"] = f"with_ {embedded}{clusters(CLUSTERS)} select id vec_id, cl::int cluster, round(sqrt(d) / {vectors.SCALE}, 4) dist from placed"
    q["diversity_sample"] = f"""with_ {embedded}{clusters(kmeans.Fits((SAMPLE,)))} select vec_id, label from embeddings where vec_id in
  (select id from (select id, 0 s from chosen union all select id, 1 from pts where id not in (select id from chosen)) join pts using (id)
   order by s, md5(concat_ws('|', '42', id::varchar)), id limit {SAMPLE})"""
    few = kmeans.Fits(PREP.few_shot_sizes, FEW_SHOT_FITS, FEW_SHOT_STEPS)
    q["prepare_few_shot_vectors"] = f"""with_ cleaned_sources as (select * from cleaned where source <> 'unanswered'), {by_source},
train as materialized (select source, source_rank, pair_id, lang, toxic, source_rank || '|' || pair_id id from splitted
  where split = 'train' and lang in ({', '.join(f"'{x}'" for x in PREP.target_langs)})),{whole_vectors("id", "toxic", "train", "hashed")},
pts as materialized (select id, lang grp, {digest("source_rank", "pair_id")} h, v from train join hashed using (id)),{clusters(few, "varchar")}
select source, source_rank, pair_id, lang, k::bigint n_shots from
  (select t.*, k, row_number() over (partition by lang, k order by c.id is null, md5(concat_ws('|', '42', source_rank::varchar, pair_id::varchar)),
   source_rank, pair_id) r from (select * from train, (select distinct k from fits)) t left join chosen c using (id, k)) where r <= k"""
    q["hashed_vectors"] = f"""with_ texts as (select doc_id, coalesce(text, '') "text" from documents), {whole_vectors("doc_id", '"text"', "texts", "hashed")}
select doc_id, array_to_string([x::int for x in v], ',') vector from hashed"""
    q["similarity_hashed"] = f"""with_ l as {trigrams("pair_id", "toxic", "parallel_filled")}, r as {trigrams("pair_id", "neutral", "parallel_filled")},
met as (select pair_id, sum(coalesce(l.n, 0) * coalesce(r.n, 0))::double ab, sum(coalesce(l.n * l.n, 0))::double aa, sum(coalesce(r.n * r.n, 0))::double bb
  from l full join r using (pair_id, place) group by pair_id)
select pair_id, round(coalesce(case when aa > 0 and bb > 0 then ab / (sqrt(aa) * sqrt(bb)) end, 0.0), 6) sim from parallel_filled left join met using (pair_id)"""
    q["nearest_to_centroid"] = "select * from nearest"
    q["diversity_fill"] = f"""select vec_id from embeddings where vec_id not in (select vec_id from nearest)
order by md5(concat_ws('|', '42', vec_id::varchar)), vec_id limit {SAMPLE}"""
    q["results_table"] = """select experiment, lang, toxicity_pct_below_threshold sta_pct, similarity_mean sim, null::double ppl,
bleu, chrf, j2_score j2, null::double j3 from baseline"""
    q["results_roundtrip"] = """select experiment, lang, n_samples, sta, toxicity_mean, toxicity_pct_below_threshold,
similarity_mean, similarity_pct_above_threshold, j2_score, round(bleu, 2) bleu, round(chrf, 2) chrf, null::double fluency_ppl_mean,
null::double fluency_norm_mean, null::double j3_score,
tox_ci_mean toxicity_ci_mean, tox_ci_lower toxicity_ci_lower, tox_ci_upper toxicity_ci_upper,
sim_ci_mean similarity_ci_mean, sim_ci_lower similarity_ci_lower, sim_ci_upper similarity_ci_upper,
j2_ci_mean, j2_ci_lower, j2_ci_upper, true from_json
from (select * exclude (fluency_ppl_mean, fluency_norm_mean, j3_score) from record) join ci using (experiment, lang) join bleu_chrf using (experiment, lang)"""
    q["results_log"] = "select experiment, lang, toxicity_mean, similarity_mean from baseline"
    q["cached_pairs"] = """select 'built' step, lang, count(*) n, 1::bigint builds from documents group by lang
union all select 'again', lang, count(*), 1 from documents group by lang
union all select 'changed', lang, count(*) * case when lang = 'en' then 2 else 1 end, 2 from documents group by lang"""
    q["enrich_runs"] = f"""select experiment, lang, toxicity_mean, similarity_mean,
n_rewrites::double n_rewrites, words_in::double words_in, words_out::double words_out from record left join (select experiment, count(*) n_rewrites, sum(len({words('toxic')}))::bigint words_in,
sum(len({words('prediction')}))::bigint words_out from rewrites where experiment <> 'identity' group by experiment)
using (experiment)"""
    q["pending_evaluations"] = "select distinct experiment, lang from rewrites where experiment = 'delete_prefix'"
    q["sample_efficiency"] = """select lang, "method", 0::bigint n_shots, toxicity_mean, similarity_mean from zero
union all select lang, "method", n_shots, toxicity_mean, similarity_mean from few"""
    q["method_comparison"] = f"""select lang,
max(toxicity_mean) filter ("method" = 'exact') exact_toxicity, max(similarity_mean) filter ("method" = 'exact') exact_similarity,
max(toxicity_mean) filter ("method" = 'prefix') prefix_toxicity, max(similarity_mean) filter ("method" = 'prefix') prefix_similarity
from few where n_shots = {vw.SERIES_SIZES[-1]} group by lang"""
    sizes = ", ".join(f"({n})" for n in (1, *vw.SERIES_SIZES))
    methods = ", ".join(f"('{m}')" for m in (*vw.SERIES_METHODS, "stem"))
    q["ablation_series"] = f"""select 'n_shots' factor, g.lang, g.v::varchar as "value", toxicity_mean, similarity_mean
from (select distinct lang, v from few, (values {sizes}) x(v)) g left join few f
on f.lang = g.lang and f.n_shots = g.v and f."method" = 'prefix'
union all select 'method', g.lang, g.v, toxicity_mean, similarity_mean
from (select distinct lang, v from few, (values {methods}) x(v)) g left join few f
on f.lang = g.lang and f."method" = g.v and f.n_shots = {vw.SERIES_SIZES[-1]}"""
    q["experiment_summary"] = """select experiment, lang, 'baseline' as "method", null::double n_shots, toxicity_mean toxicity,
toxicity_pct_below_threshold tox_below_pct, similarity_mean similarity, bleu from baseline
union all select experiment, lang, "method", 0, toxicity_mean, toxicity_pct_below_threshold, similarity_mean, null from zero
union all select experiment, lang, "method", n_shots, toxicity_mean, toxicity_pct_below_threshold, similarity_mean, null from few"""
    q["detox_report"] = "with_ " + (
        deleted("toxic_inputs", "row_id", "lex_terms", "exact", "cut") + ","
        + "both_texts as (select i.row_id, i.lang, i.text, cut.prediction from toxic_inputs i join cut using (row_id)),"
        + flagged_counts("both_texts", "row_id", "text", "lex_judge", "prefix", "before") + ","
        + flagged_counts("both_texts", "row_id", "prediction", "lex_judge", "prefix", "after_")
    ) + """ select b.lang, count(*) n_texts, round(avg(b.tox), 6) tox_before, round(avg(a.tox), 6) tox_after,
round(avg((b.tox < 0.5)::int::double), 6) sta_before, round(avg((a.tox < 0.5)::int::double), 6) sta_after
from before b join after_ a using (row_id) group by b.lang"""
    found = {name: _finish(body) for name, body in q.items()}
    # the same over all documents: only the inputs differ
    for name, source in (("corpus_bleu_all", "corpus_bleu"), ("corpus_chrf_all", "corpus_chrf"),
                         ("evaluate_documents", "evaluate_ref"), ("join_predictions_all", "join_predictions"),
                         ("score_rows_all", "score_rows"), ("j_scores_all", "j_scores"), ("evaluate_noref_all", "evaluate_noref")):
        found[name] = found[source].replace(PARTS["toxic_inputs"], ALL_INPUTS)
    return found


ALL_INPUTS = "toxic_inputs as (select doc_id row_id, lang, text from documents)"


def _finish(body: str) -> str:
    """Put the parts in front; a body starting with ``with_`` brings more of its own."""
    if not body.startswith("with_ "):
        return sql(body)
    own = body[len("with_ "):].strip()
    head = sql(own)[: -len(own)]
    return ((head.rstrip() + ",\n" if head else "with ") + own).replace("with ", "with recursive " if "from took" in own else "with ", 1)


ORACLE_SQL = build()
