"""DuckDB SQL for the queries of this package, written apart from the Spark plans."""

from __future__ import annotations

from textloom.operators.watermarks import HOMOGLYPHS, SYNONYMS  # fixed values

W = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?"
TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{W}')"
TOKENS = f"regexp_extract_all(coalesce(text, ''), '{TOK}')"
BR = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LINES = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BR}'), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}]'))"
Z = 1.959963984540054


def key(c: str) -> str:
    return f"nullif(lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


RECORDS = "(select distinct on (record_id) * from corpus_records order by record_id)"
SCORED = """(select doc_id, label as y, round((('0x' || substr(sha256(cast(doc_id as varchar)), 1, 6))::bigint % 1000 + 400 * label) / 1400.0, 3) as p,
    kind, family, author, source, coalesce(lang, 'none') as lang from documents)"""
# Tokens with the flag of the green list, in order.
GREEN = f"""(select doc_id, i, substr(sha256('demo-key::' || coalesce(lag(t) over (partition by doc_id order by i), '') || '::' || t), 1, 1) < '8' as g
    from (select doc_id, unnest({TOKENS}) as t, unnest(range(len({TOKENS}))) as i from documents))"""
SEGMENTS = f"""(with g as {GREEN}, n as (select doc_id, count(*) as n from g group by 1),
    s as (select doc_id, n, unnest(range(greatest(cast(ceil((n - 160) / 128.0) as bigint), 0) + 1)) as k from n)
    select s.doc_id, cast(k as integer) as segment_no, cast(count(*) as integer) as n_tokens, cast(sum(g.g::int) as integer) as green
    from s join g on g.doc_id = s.doc_id and g.i >= k * 128 and g.i < k * 128 + 160 group by 1, 2)"""
KGW = f"""(select d.doc_id, cast(coalesce(n, 0) as integer) as n_tokens, case when n >= 50 then cast(k as double) end as green from documents d
    left join (select doc_id, count(*) as n, sum(g::int) as k from {GREEN} group by 1) using (doc_id))"""
FEATURES = f"""(with t as (select doc_id, coalesce(text, '') as text, coalesce(kind = 'code', false) as code, family, kind, label from documents),
    w as (select doc_id, unnest(regexp_extract_all(lower(text), '{W}')) as w from t),
    c as (select doc_id, w, count(*) as c from w group by 1, 2),
    a as (select doc_id, sum(c) as n, count(*) as kinds, sum((c = 1)::int) as once, sum(c * log2(c)) as clogc, sum(case when length(w) >= 7 then c else 0 end) as long_,
        sum(case when w in ('however', 'therefore', 'moreover', 'additionally', 'overall', 'furthermore') then c else 0 end) as conn,
        sum(c * length(w)) / sum(c) as wm, sum(c * length(w) * length(w)) / sum(c) as w2 from c group by 1),
    s as (select doc_id, len(regexp_extract_all(x, '{W}')) as k from (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) as x from t) where regexp_matches(x, '[^\\s\\p{{Z}}]')),
    sa as (select doc_id, avg(k) as sm, coalesce(stddev_samp(k), 0) as ssd, avg((k < 14)::int) as short from s group by 1),
    l as (select doc_id, length(x) as k from (select doc_id, unnest(regexp_split_to_array(text, '{BR}')) as x from t) where regexp_matches(x, '[^\\s\\p{{Z}}]')),
    la as (select doc_id, avg(k) as lm, coalesce(stddev_samp(k), 0) as lsd from l group by 1),
    m as (select doc_id, (length(text) - length(replace(text, chr(10) || '-', ''))) / 2 + (length(text) - length(replace(text, chr(10) || '*', ''))) / 2
        + length(regexp_replace(text, '[^:;()\\[\\]]', '', 'g')) as marks, length(regexp_replace(text, '[^\\p{{Nd}}²³¹]', '', 'g')) as dig,
        length(regexp_replace(text, '[^.,;:!?()\\[\\]{{}}]', '', 'g')) as pun, length(text) as len from t)
    select t.doc_id, t.family, t.kind, t.label, coalesce(long_ / n, 0) as long_words, coalesce(conn / n, 0) as connectors, coalesce(kinds / n, 0) as unique_ratio,
        case when n > 0 then coalesce(short, 0) else 0 end as short_sentences, case when n is null then 0 when code then 1 else marks / greatest(len / 80, 1) end as structured,
        case when n > 0 then dig / greatest(len, 1) else 0 end as digits, case when n > 0 then greatest(0, 1 - lsd / greatest(lm, 1)) else 0 end as balanced_lines,
        coalesce(log2(n) - clogc / n, 0) as token_entropy, case when n > 0 then pun / greatest(len, 1) else 0 end as punctuation, coalesce(wm, 0) as mean_word_length,
        coalesce(w2 - wm * wm, 0) as word_length_var, case when n > 0 then lm else 0 end as avg_line_len, case when n > 0 then lsd else 0 end as line_sd,
        case when n > 0 then coalesce(sm, 0) else 0 end as sentence_len_mean, case when n > 0 then coalesce(ssd, 0) else 0 end as sentence_len_sd,
        coalesce(once / n, 0) as hapax_ratio, coalesce(ln(1 + n), 0) as log_words, len
    from t left join a using (doc_id) left join sa using (doc_id) left join la using (doc_id) join m using (doc_id))"""
NAMES = ("long_words", "connectors", "unique_ratio", "short_sentences", "structured", "digits", "balanced_lines", "token_entropy", "punctuation", "mean_word_length", "word_length_var", "avg_line_len", "line_sd", "sentence_len_mean", "sentence_len_sd", "hapax_ratio", "log_words")
PROSE = f"""(with t as (select doc_id, coalesce(text, '') as text from documents), w as (select doc_id, unnest(regexp_extract_all(lower(text), '{W}')) as w from t),
    a as (select doc_id, count(*) as n, avg(length(w)) as wl, avg((length(w) >= 7)::int) as lw, count(distinct w) / count(*) as u,
        avg((w in ('however', 'therefore', 'moreover', 'furthermore', 'additionally', 'overall'))::int) as c from w group by 1),
    s as (select doc_id, avg(k) as sm, coalesce(stddev_samp(k), 0) as ssd from (select doc_id, len(regexp_extract_all(unnest(regexp_split_to_array(text, '[.!?]+')), '{W}')) as k from t) where k > 0 group by 1),
    l as (select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as a, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as b from t),
    r as (select t.doc_id, case when coalesce(n, 0) < 40 then 'insufficient' when not (b > 0 and a / b > 0.85) then 'language' end as abstain_reason, wl, lw, u, c, sm, ssd
        from t left join a using (doc_id) left join s using (doc_id) join l using (doc_id))
    select doc_id, case when abstain_reason is null then least(0.98, greatest(0.02, 0.5 + 0.18 * (least(3, greatest(-2, wl - 4.7)) + 2) / 5 + 0.16 * (least(0.25, greatest(-0.15, lw - 0.16)) + 0.15) / 0.4
        + 0.15 * (least(0.2, greatest(-0.2, 0.25 - ssd / greatest(sm, 1))) + 0.2) / 0.4 + 0.12 * (least(0.06, greatest(-0.02, c - 0.012)) + 0.02) / 0.08
        - 0.16 * (least(0.3, greatest(-0.2, u - 0.58)) + 0.2) / 0.5)) else 0.5 end as raw_score, abstain_reason from r)"""
RANKS = """with s as {src}, g as (select {k} p, sum(y) as pos, sum(1 - y) as neg from s group by all),
    b as (select *, coalesce(sum(pos) over (partition by {part} order by p rows between unbounded preceding and 1 preceding), 0) as pb,
        coalesce(sum(neg) over (partition by {part} order by p rows between unbounded preceding and 1 preceding), 0) as nb,
        sum(pos) over (partition by {part}) as tp, sum(neg) over (partition by {part}) as tn from g)"""


def features_of(src: str) -> str:
    """``FEATURES`` of other rows with the columns of documents."""
    return FEATURES.replace("kind, label from documents)", f"kind, label from {src})")


def prose_of(src: str) -> str:
    return PROSE.replace("as text from documents)", f"as text from {src})")


CODE_SCORE = f"""(with t as (select doc_id, coalesce(text, '') as text from documents where kind = 'code'), w as (select doc_id, regexp_extract_all(text, '{W}') as w from t), l as (select doc_id, {LINES} as ls from t),
    i as (select doc_id, len(w) as n, list_filter(w, lambda x: regexp_full_match(x, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*')) as ids from w),
    p as (select doc_id, n, len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '^[\\s\\p{{Z}}]+', ''), '^(#|//|/\\*|\\*)'))) / greatest(len(ls), 1) as comment, len(list_filter(ids, lambda x: length(x) >= 14)) / greatest(len(ids), 1) as long_, len(list_distinct(ids)) / greatest(len(ids), 1) as uniq,
        list_transform(list_filter(ls, lambda x: x[1] = ' '), lambda x: length(x) - length(regexp_replace(x, '^ +', ''))) as ind,
        (contains(lower(text), 'example')::int + contains(lower(text), 'usage')::int + contains(lower(text), 'todo')::int + contains(lower(text), 'note:')::int + contains(lower(text), 'this function')::int + contains(lower(text), 'returns')::int) / 6 as boiler from t join i using (doc_id) join l using (doc_id))
    select doc_id, case when n >= 25 then least(0.98, greatest(0.02, 0.48 + 0.16 * (least(0.25, greatest(-0.08, comment - 0.08)) + 0.08) / 0.33 + 0.13 * (least(0.22, greatest(-0.08, long_ - 0.08)) + 0.08) / 0.3
        + 0.12 * (least(0.25, greatest(-0.5, case when len(ind) < 2 then 0.5 else len(list_filter(ind, lambda x: x % 2 = 0)) / len(ind) end - 0.72)) + 0.5) / 0.75 + 0.10 * (least(0.5, greatest(-0.2, boiler - 0.2)) + 0.2) / 0.7
        - 0.15 * (least(0.2, greatest(-0.3, uniq - 0.78)) + 0.3) / 0.5)) else 0.5 end as raw_score, case when n < 25 then 'insufficient' end as abstain_reason from p)"""


def metrics_sql(k: str, src: str = SCORED) -> str:
    kk, part = (f"{k},", k) if k else ("", "1")
    by = f"group by {k}" if k else ""
    on = f"using ({k})" if k else "on true"
    tpr = lambda f, n: f"(select {kk} avg((p >= th)::int) as {n} from s join (select {kk} p as th from b where neg > 0 and nb <= ceil({1 - f} * (tn - 1) - 1e-9) and ceil({1 - f} * (tn - 1) - 1e-9) < nb + neg) {on} where y = 1 {by})"
    bins = "case " + " ".join(f"when p >= {i * 0.1!r} and p < {((i + 1) * 0.1 if i < 9 else 1.0)!r} then {i}" for i in range(10)) + " end"
    return f"""{RANKS.format(src=src, k=kk, part=part)}
    select {kk} n, round(brier, 6) as brier, round(accuracy, 6) as accuracy, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(ece, 6) as ece, round(tpr_at_01fpr, 6) as tpr_at_01fpr, round(tpr_at_1fpr, 6) as tpr_at_1fpr, round(tpr_at_5fpr, 6) as tpr_at_5fpr
    from (select {kk} count(*) as n, avg((p - y) * (p - y)) as brier, avg(((p >= 0.5)::int = y)::int) as accuracy from s {by})
    join (select {kk} sum(pos * (nb + neg / 2)) / (max(tp) * max(tn)) as auroc, sum(pos * (tp - pb) / (tp - pb + tn - nb)) / max(tp) as auprc from b {by}) {on}
    join (select {kk} sum(m * abs(mp - my)) / max(c) as ece from (select {kk} bin, count(*) as m, avg(p) as mp, avg(y) as my from (select *, {bins} as bin from s) where bin is not null group by all)
        join (select {kk} count(*) as c from s {by}) {on} {by}) {on}
    join {tpr(0.001, 'tpr_at_01fpr')} {on} join {tpr(0.01, 'tpr_at_1fpr')} {on} join {tpr(0.05, 'tpr_at_5fpr')} {on}"""


BINS = "case " + " ".join(f"when p >= {i * 0.1!r} and p < {((i + 1) * 0.1 if i < 9 else 1.0)!r} then {i}" for i in range(10)) + " end"
U = "('0x' || substr(sha256({x}), 1, 8))::bigint / 4294967296.0"
MOD = "(" + " + ".join(f"('0x' || substr(h, {i * 4 + 1}, 4))::bigint * {pow(65536, 15 - i, 10000)}" for i in range(16)) + ") % 10000"
WRITER = f"(select author, case when m < 4000 then 'train' when m < 5500 then 'development' when m < 7000 then 'calibration' else 'test' end as partition from (select author, {MOD} as m from (select distinct author, sha256('20260819:' || author) as h from documents where author is not null)))"
SHINGLES = """list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) else w end)"""


# Lines that look like code.
CODE_LINE = r"def |function |const |let |var |class |import |from |public static|#include|package |fn |=>|[{}();]$"
RULES = {
    "mage": ("as an ai language model|i cannot fulfill this request|openai|content policy", "kept"),
    "defactify": (r"error communicating with|api\.openai\.com|nameresolutionerror|max retries exceeded|httpsconnectionpool|openai api error|ratelimiterror|apiconnectionerror", "all"),
    "raid": ("$^x", "all"),
    "m4gt": ("$^x", "all"),
}
STRIPPED = "regexp_replace(coalesce(text, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
SPLIT4 = f"(select doc_id, case when m < 4000 then 'train' when m < 5500 then 'development' when m < 7000 then 'calibration' else 'test' end as partition from (select doc_id, {MOD} as m from (select doc_id, sha256('partition:' || cast(doc_id as varchar)) as h from documents)))"
CAL = f"(select s.* from {SCORED} s join {SPLIT4} using (doc_id) where partition = 'calibration')"
TEST = f"(select s.* from {SCORED} s join {SPLIT4} using (doc_id) where partition = 'test')"
TWO = f"(select *, round((p + doc_id % 7 / 10.0) / 1.6, 6) as q from {SCORED})"


def hygiene_sql(rules: str) -> str:
    marker, seen = RULES[rules]
    own = "when n < 50 then 'short' when doc_id <> low then 'duplicate'" if seen == "kept" else "when doc_id <> low then 'duplicate' when n < 50 then 'short'"
    return f"""select doc_id, case when t = '' then 'empty' when regexp_matches(lower(t), '{marker}') then 'marker' {own} else 'keep' end as reason
        from (select doc_id, t, len(list_filter(regexp_split_to_array(t, '[\\s\\p{{Z}}]+'), lambda w: w <> '')) as n, min(doc_id) over (partition by t) as low from (select doc_id, {STRIPPED} as t from documents))"""


def higher(src: str, value: str, q: str) -> str:
    """The "higher" quantile of a value."""
    return f"(select v from (select {value} as v, row_number() over (order by {value}) - 1 as i, count(*) over () as n from {src}) where i = ceil(({q}) * (n - 1) - 1e-9) limit 1)"


LEVEL = "greatest(0, least(1, ceil((n + 1) * 0.9) / n))"
NON = "case when y = 1 then 1 - p else p end"
DRAWS = f"""(select "group", replicate, {{cols}}, case when u < {0.36787944117144233!r} then 0 {{steps}} end as m from (select *, {U.format(x="'11:' || \"group\" || ':' || cast(replicate as varchar)")} as u from {{src}}, (select unnest(range(200)) as replicate)))"""


def draws(src: str, cols: str) -> str:
    """Groups with their Poisson multiplicities in each of 200 replicates."""
    cdf, k, steps = 0.0, 1.0, ""
    for i in range(13):
        k = k / i if i else 1.0
        cdf += 0.36787944117144233 * k
        steps += f" when u < {cdf!r} then {i}" if i else ""
    return DRAWS.format(src=src, cols=cols, steps=steps + " else 13")


def boot_auroc(p: str) -> str:
    g = draws(f"""(select author as "group", {p} as p, sum(y) as pos, sum(1 - y) as neg from {TWO} where author is not null group by 1, 2)""", "p, pos, neg")
    return f"""(with d as (select replicate, p, sum(m * pos) as pos, sum(m * neg) as neg from {g} where m > 0 group by 1, 2),
        c as (select *, coalesce(sum(neg) over (partition by replicate order by p rows between unbounded preceding and 1 preceding), 0) as nb from d)
        select replicate, sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) as auroc from c group by 1)"""


def boot_sums(p: str) -> str:
    g = draws(f"""(select author as "group", count(*) as n, sum(({p} - y) * ({p} - y)) as sq, sum((({p} >= 0.5)::int = y)::int) as ok from {TWO} where author is not null group by 1)""", "n, sq, ok")
    return f"(select replicate, sum(m * sq) / sum(m * n) as brier, sum(m * ok) / sum(m * n) as accuracy from {g} where m > 0 group by 1)"


def point_sql(p: str) -> str:
    return f"""(with s as (select y, {p} as p from {TWO} where author is not null), g as (select p, sum(y) as pos, sum(1 - y) as neg from s group by 1), c as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as nb from g)
        select (select sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) from c) as auroc, avg((p - y) * (p - y)) as brier, avg(((p >= 0.5)::int = y)::int) as accuracy from s)"""


def isotonic(src: str) -> str:
    """The isotonic fit at each distinct score: the largest, over starts up to it, of the smallest mean from there
    to an end beyond it."""
    return f"""(with g as (select p, count(*) as w, sum(y) as s from {src} group by 1), c as (select p, w, s, row_number() over (order by p) as i, sum(w) over (order by p) as cw, sum(s) over (order by p) as cs from g),
        m as (select a.i as j, b.i as k, b.p, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as mean from c a join c b on b.i >= a.i),
        f as (select j, k, p, min(mean) over (partition by j order by k desc rows between unbounded preceding and current row) as low from m) select p, max(low) as fit from f group by 1)"""


def placements(s: str) -> str:
    """Each row's share of the other class that its score beats, ties half."""
    return f"""(with g as (select {s} as s, sum(y) as pos, sum(1 - y) as neg from {TWO} group by 1), c as (select *, sum(neg) over (order by s) - neg as nb, sum(pos) over (order by s) - pos as pb, sum(pos) over () as tp, sum(neg) over () as tn from g)
        select doc_id, y, case when y = 1 then (nb + neg / 2) / tn else 1 - (pb + pos / 2) / tp end as v from {TWO} t join c on t.{s} = c.s)"""


PAIR_SIDES = f"""r as (select distinct record_id, {key('prompt_id')} as g, kind, label from corpus_records), n as (select g, kind, sum(1 - label) as h, sum(label) as a from r where g is not null and label in (0, 1) group by 1, 2 having sum(1 - label) > 0 and sum(label) > 0),
    k as (select *, row_number() over (partition by g, kind, label order by md5(cast(record_id as varchar)), record_id) - 1 as i from r where g is not null and label in (0, 1))"""


def folds_sql(unit: str) -> str:
    """Groups from the largest on, each to the lightest of five folds."""
    return f"""(with recursive g as (select {unit} as u, count(*) as n from documents where {unit} is not null group by 1), o as (select *, row_number() over (order by n desc, md5(u), u) as i, least(5, count(*) over ()) as k from g),
        s as (select 0 as i, cast(null as varchar) as u, cast(0 as bigint) as n, cast(0 as bigint) as fold, list_transform(range(greatest(2, (select max(k) from o))), lambda x: cast(0 as bigint)) as l
            union all select o.i, o.u, o.n, list_position(l, list_min(l)) - 1, list_transform(range(1, len(l) + 1), lambda x: case when x = list_position(l, list_min(l)) then l[x] + o.n else l[x] end) from s join o on o.i = s.i + 1)
        select u, n, cast(fold as integer) as fold from s where i > 0)"""


def nested_sql(unit: str) -> str:
    """Each fold's groups as test; of the others a quarter to calibration, first one of either majority."""
    return f"""(with f as {folds_sql(unit)}, m as (select {unit} as u, cast(sum(label) * 2 >= count(*) as integer) as majority from documents where {unit} is not null group by 1), t as (select distinct fold as o from f),
        x as (select t.o, f.u, f.fold, majority, sha256('13:' || t.o || ':' || f.u) as h from f join m using (u), t), r as (select *, h = min(h) over (partition by o, majority) as first, count(*) over (partition by o) as n, min(majority) over (partition by o) <> max(majority) over (partition by o) as two from x where fold <> o),
        c as (select *, least(greatest(n // 4, case when two and n >= 3 then 2 else 1 end), n - 1) as many from r), d as (select *, row_number() over (partition by o order by case when many >= 2 and two and first then 0 else 1 end, md5(h), h) - 1 as i from c)
        select o as fold, u as "group", case when i < many then 'calibration' else 'train' end as partition from d union all select o, u, 'test' from x where fold = o)"""


def isotonic_by(src: str, key_: str) -> str:
    return f"""(with g as (select {key_} as source, p, count(*) as w, sum(y) as s from {src} group by 1, 2), c as (select source, p, w, s, row_number() over (partition by source order by p) as i, sum(w) over (partition by source order by p) as cw, sum(s) over (partition by source order by p) as cs from g),
        m as (select a.source, a.i as j, b.i as k, b.p, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) as mean from c a join c b on a.source = b.source and b.i >= a.i), f as (select source, j, k, p, min(mean) over (partition by source, j order by k desc rows between unbounded preceding and current row) as low from m)
        select source, p, max(low) as fit from f group by 1, 2)"""


def transfers() -> str:
    """Test rows of each language under the isotonic map of each language's calibration rows."""
    ok = lambda src: f"(select lang from {src} group by 1 having count(*) >= 30 and min(y) < max(y))"
    return f"""(with f as materialized (select * from {isotonic_by(CAL, 'lang')} where source in {ok(CAL)}), t as (select * from {TEST} where lang in {ok(TEST)}),
        x as (select q.source, t.lang as target, t.y, t.p, (select max(f.p) from f where f.source = q.source and f.p <= t.p) as a, (select min(f.p) from f where f.source = q.source and f.p > t.p) as b from t, (select distinct source from f) q)
        select x.source, target, y, greatest(1e-6, least(1 - 1e-6, case when a is null then fb.fit when b is null then fa.fit else fa.fit + (x.p - a) * (fb.fit - fa.fit) / (b - a) end)) as p from x left join f fa on fa.source = x.source and fa.p = a left join f fb on fb.source = x.source and fb.p = b)"""


def mixtures(flows: str) -> str:
    """Scores of the pairs' mixtures at each rate."""
    return f"""(with {PAIR_SIDES}, p as (select g, kind, h, a, unnest(range(greatest(h, a)::bigint)) as k from n), z as (select x.record_id as hid, y.record_id as aid from p join k x on x.g = p.g and x.kind = p.kind and x.label = 0 and x.i = p.k % p.h join k y on y.g = p.g and y.kind = p.kind and y.label = 1 and y.i = p.k % p.a),
        w as (select record_id, regexp_extract_all(lower(text), '{W}') as w from texts), q as (select row_number() over () as doc_id, x.w as h, y.w as a, rate, flow, least(round_even(len(x.w) * rate, 0)::bigint, len(y.w)) as k from z join w x on x.record_id = hid join w y on y.record_id = aid, (select unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::double as rate), (select unnest({flows}) as flow)),
        m as materialized (select doc_id, rate, flow, array_to_string(case when len(h) = 0 then case when rate >= 1 then a else [] end when flow = 'ai_prefix' then list_concat(a[1:k], h[k + 1:]) when flow = 'ai_suffix' then list_concat(h[1:len(h) - k], a[1:k]) else list_concat(a[1:k], h[1:len(h) - k]) end, ' ') as text from q)
        select rate, flow as workflow, raw_score from m join {prose_of('m')} using (doc_id))""".replace("from corpus_records)", "from texts)").replace("(with ", f"(with texts as (select * from {RECORDS} where text is not null and kind = 'text'), ", 1)


X5 = ("long_words", "unique_ratio", "sentence_len_mean", "punctuation", "log_words")
SQL: dict[str, str] = {
    "kgw_detect": f"""select doc_id, n_tokens, green, round((green - n_tokens * 0.5) / sqrt(n_tokens * 0.25), 6) as z, round(green / n_tokens, 6) as green_rate, round(green / n_tokens - 0.5, 6) as effect,
        round(case when green is not null then greatest(0, least(1, (green / n_tokens - 0.5) / 0.5)) end, 6) as dilution,
        round(case when green is not null then greatest(0, (green / n_tokens + {Z * Z} / (2 * n_tokens)) / (1 + {Z * Z} / n_tokens) - {Z} * sqrt((green / n_tokens * (1 - green / n_tokens) + {Z * Z} / (4 * n_tokens)) / n_tokens) / (1 + {Z * Z} / n_tokens)) end, 6) as rate_low,
        round(case when green is not null then least(1, (green / n_tokens + {Z * Z} / (2 * n_tokens)) / (1 + {Z * Z} / n_tokens) + {Z} * sqrt((green / n_tokens * (1 - green / n_tokens) + {Z * Z} / (4 * n_tokens)) / n_tokens) / (1 + {Z * Z} / n_tokens)) end, 6) as rate_high from {KGW}""",
    "kgw_segments": f"select *, round(case when n_tokens >= 20 then (green - n_tokens * 0.5) / sqrt(n_tokens * 0.25) end, 6) as z from {SEGMENTS}",
    "kgw_screen": f"select label, kind, count(*) as tested, round(avg((z > 1.6448536269514722)::int), 6) as reject_rate, round(avg(z), 6) as mean_z, round(avg(green / n_tokens), 6) as mean_green_rate from (select *, (green - n_tokens * 0.5) / sqrt(n_tokens * 0.25) as z from {KGW} where green is not null) join documents using (doc_id) group by 1, 2",
    "kgw_flags": f"select doc_id, n_tokens, green, round((green - n_tokens * 0.5) / sqrt(n_tokens * 0.25), 6) as z from {KGW} where green is not null order by z desc, doc_id limit 50",
    "zero_width_roundtrip": f"""select doc_id, cast(n as integer) as n_marks, round(case when n >= 8 then hit / n else 0 end, 6) as payload_match, n >= 8 and hit / n >= 0.9 as present from (
        select doc_id, len(b) as n, len(list_filter(range(1, len(b) + 1), lambda i: b[i] = s[(i - 1) % 16 + 1])) as hit from (
        select doc_id, regexp_extract_all(array_to_string(list_transform(range(1, len(w) + 1), lambda i: s[(i - 1) % 16 + 1] || w[i]), ' '), chr(8203) || '|' || chr(8204)) as b, s from (
        select doc_id, string_split(coalesce(text, ''), ' ') as w, [{", ".join("chr(8203)" if b else "chr(8204)" for b in (1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0, 1, 0))}] as s from documents)))""",
    "zero_width_stripped": "select false as present, count(*) as n, cast(0 as bigint) as marks from documents",
    "attack_texts": f"""select doc_id, sha256(array_to_string(list_filter(w, lambda x, i: {U.format(x="'7:' || cast(doc_id as varchar) || ':' || cast(i - 1 as varchar)")} >= 0.2), ' ')) as drop_tokens, sha256(lower(t)) as lowercase,
        sha256(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g')) as strip_punctuation, sha256(array_to_string(w[1:greatest(1, cast(floor(len(w) * 0.5) as bigint))], ' ')) as truncate
        from (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from documents)""",
    "bigram_counts": f"select prev, t as next, count(*) as n from (select doc_id, t, lag(t) over (partition by doc_id order by i) as prev from (select doc_id, unnest(k) as t, unnest(range(len(k))) as i from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') as k from documents))) where prev is not null group by 1, 2 having count(*) >= 5",
    "bigram_nll": f"""with k as (select doc_id, label, t, lag(t) over (partition by doc_id order by i) as prev from (select doc_id, label, unnest(k) as t, unnest(range(len(k))) as i from (select doc_id, label, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') as k from documents))),
        bi as (select prev, t, count(*) as n from k where label = 1 and prev is not null group by 1, 2), af as (select prev, sum(n) as a from bi group by 1), uni as (select t, count(*) as n1 from k where label = 1 group by 1),
        v as (select count(*) as v, sum(n1) as tot from uni)
        select doc_id, count(*) as pairs, round(avg(-ln(case when a is not null then (coalesce(n, 0) + 0.5) / (a + 0.5 * v) else (coalesce(n1, 0) + 0.5) / (tot + 0.5 * v) end)), 6) as nll
        from k left join bi using (prev, t) left join af using (prev) left join uni using (t) cross join v where label = 0 and prev is not null group by 1""",
    "token_counts": f"select doc_id, cast(len({WORDS}) as integer) as n_words, cast(len({TOKENS}) as integer) as n_tokens, case when len({WORDS}) < 50 then 'lt50' when len({WORDS}) < 150 then '50-149' when len({WORDS}) < 500 then '150-499' else '500plus' end as bucket, sha256(coalesce(text, '')) as content_hash from documents",
    "content_types": f"""select doc_id, case when r >= 0.35 then 'code' when r >= 0.12 then 'mixed' else 'prose' end as content_type, case when b > 0 and a / b > 0.85 then 'en' else 'unknown' end as language from (
        select doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) as a, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) as b,
        case when len({LINES}) > 0 then len(list_filter({LINES}, lambda x: regexp_matches(regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '{CODE_LINE}'))) / len({LINES}) else 0 end as r from documents)""",
    "segment_windows": f"select doc_id, cast(k as integer) as segment_no, cast(k * 128 as integer) as token_start, cast(least(k * 128 + 160, n) as integer) as token_end from (select doc_id, n, unnest(range(greatest(cast(ceil((n - 160) / 128.0) as bigint), 0) + 1)) as k from (select doc_id, len({TOKENS}) as n from documents) where n > 0)",
    "equal_thirds": "select doc_id, n // 3 as third_0, n * 2 // 3 - n // 3 as third_1, n - n * 2 // 3 as third_2 from (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as n from documents)",
    "stylometry": f"select doc_id, {', '.join(f'round({c}, 6) as {c}' for c in NAMES)} from {FEATURES}",
    "stylometry_by_family": f"select family, kind, count(*) as n, {', '.join(f'round({f}({c}), 5) as {c}_{n}' for c in ('token_entropy', 'unique_ratio', 'sentence_len_mean') for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} from {FEATURES} group by 1, 2",
    "prose_scores": f"select doc_id, round(raw_score, 6) as raw_score, abstain_reason from {PROSE}",
    "source_families": f"""select doc_id, {', '.join(f'round(e{i} / s, 6) as p_{n}' for i, n in enumerate(('llama', 'mistral', 'qwen', 'gpt', 'gemma')))},
        round(least(1, greatest(0, least(1, -({' + '.join(f'e{i} / s * ln(e{i} / s)' for i in range(5))}) / ln(5))) + case when len < 500 then 0.25 else 0 end), 6) as unknown_score from (
        select *, e0 + e1 + e2 + e3 + e4 as s from (select doc_id, len, exp(-1.0 + 1.4 * long_words + 0.5 * connectors) as e0, exp(-1.1 + 1.1 * unique_ratio + 0.4 * short_sentences) as e1, exp(-1.2 + 1.2 * structured + 0.5 * digits) as e2,
        exp(-0.9 + 1.3 * connectors + 0.4 * balanced_lines) as e3, exp(-1.3 + 1.0 * short_sentences + 0.4 * unique_ratio) as e4 from {FEATURES}))""",
    "corpus_hygiene": " union all ".join(f"select '{r}' as rules, reason, count(*) as n from ({hygiene_sql(r)}) group by 2" for r in RULES),
    "exact_copies": "select doc_id, low as first_id from (select doc_id, min(doc_id) over (partition by text) as low from documents where text is not null) where doc_id <> low",
    "corpus_datasheet": f"select family, kind, case when n < 50 then 'lt50' when n < 150 then '50-149' when n < 500 then '150-499' else '500plus' end as bucket, count(*) as n, cast(sum(label) as bigint) as ai from (select *, len({WORDS}) as n from {RECORDS}) group by 1, 2, 3",
    "contamination_status": f"select family, kind, count(*) as n, ['declared-none', 'unknown', 'suspected', 'declared-active'][max(case watermark_status when 'declared-active' then 3 when 'suspected' then 2 when 'declared-none' then 0 else 1 end) + 1] as status from {RECORDS} group by 1, 2",
    "run_merkle_roots": f"""with recursive h as (select {key('run_id')} as run, sha256(text) as h from {RECORDS} where text is not null), g as (select run, count(*) as n, list_sort(list(h)) as a from h where run is not null group by 1),
        r as (select run, n, a from g union all select run, n, list_transform(range(1, (len(a) + 1) // 2 + 1), lambda i: sha256(a[2 * i - 1] || coalesce(a[2 * i], a[2 * i - 1]))) from r where len(a) > 1)
        select run, n, a[1] as merkle_root from r where len(a) = 1""",
    "run_registry": f"select run, count(*) as submissions, arg_min(model_slug, (submitted_utc, model_slug)) as model_slug, arg_min_null(provider, (submitted_utc, model_slug)) as provider, strftime(arg_min(created_utc, (submitted_utc, model_slug)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as created_utc, strftime(arg_min(submitted_utc, (submitted_utc, model_slug)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as submitted_utc from (select *, {key('run_id')} as run from runs) where run is not null group by 1",
    "catalog_problems": f"""with a as (select distinct {key('run_id')} as run from corpus_records), b as (select {key('run_id')} as run, count(*) as n, count(distinct merkle_root) as roots from runs group by 1)
        select run, 'dangling' as problem from a where run is not null and run not in (select run from b where run is not null) union all select run, 'unreferenced' from b where run is not null and run not in (select run from a where run is not null)
        union all select run, 'duplicate' from b where run is not null and n > 1 union all select run, 'root mismatch' from b where run is not null and roots > 1""",
    "stale_hashes": f"select record_id, sha256 is null as absent from (select record_id, r.sha256, sha256(text) as h from {RECORDS} r where text is not null) where not coalesce(lower(trim(sha256)) = h, false)",
    "output_counts": f"select run, max(n_outputs) as registered, any_value(found) as found from (select {key('run_id')} as run, n_outputs from runs) join (select {key('run_id')} as run, count(distinct record_id) as found from corpus_records group by 1) using (run) where run is not null group by 1 having max(n_outputs) <> any_value(found)",
    "author_copies_jaccard": f"""with s as (select doc_id, {SHINGLES} as s from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') as w from documents)),
        p as (select lag(doc_id) over (partition by source order by doc_id) as a, doc_id as b from documents)
        select a, b, round(case when len(x.s) + len(y.s) > 0 then len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) else 1 end, 6) as similarity from p join s x on x.doc_id = a join s y on y.doc_id = b where a is not null""",
    "group_subsample": "select doc_id, author from documents where author in (select author from (select author, n, sum(n) over (order by sha256('7:' || author)) as c from (select author, count(*) as n from documents where author is not null group by 1)) where c <= 300 or c = n)",
    "group_partitions": "select author as \"group\", case when i < round_even(n * 0.6, 0) then 'train' when i < round_even(n * 0.8, 0) then 'calibration' else 'test' end as partition from (select author, row_number() over (order by sha256('7:partition:' || author)) - 1 as i, count(*) over () as n from (select distinct author from documents where author is not null))",
    "writer_splits": f"select author, partition from {WRITER}",
    "split_leaks": f"select run, count(distinct lower(trim(split))) as partitions from (select {key('run_id')} as run, split from corpus_records) where run is not null and split is not null group by 1 having count(distinct lower(trim(split))) > 1",
    "leakage_by_prompt": f"with r as (select distinct record_id, split, {key('prompt_id')} as g from corpus_records), d as (select * from r where g is not null and split is not null) select split, count(*) as n, sum((g in (select g from d where split = 'train'))::int)::bigint as leaked from d where split <> 'train' group by 1",
    "balanced_folds": """with recursive g as (select author, count(*) as n from documents where author is not null group by 1), o as (select *, row_number() over (order by n desc, md5(author), author) as i, least(5, count(*) over ()) as k from g),
        s as (select 0 as i, cast(null as varchar) as author, cast(0 as bigint) as n, cast(0 as bigint) as fold, list_transform(range(greatest(2, (select max(k) from o))), lambda x: cast(0 as bigint)) as l
            union all select o.i, o.author, o.n, list_position(l, list_min(l)) - 1, list_transform(range(1, len(l) + 1), lambda x: case when x = list_position(l, list_min(l)) then l[x] + o.n else l[x] end) from s join o on o.i = s.i + 1)
        select author, n, cast(fold as integer) as fold from s where i > 0""",
    "prompt_pairs": f"""with {PAIR_SIDES}, p as (select g, kind, h, a, unnest(range(greatest(h, a)::bigint)) as k from n)
        select p.g as "group", p.kind, x.record_id as human_id, y.record_id as ai_id from p join k x on x.g = p.g and x.kind = p.kind and x.label = 0 and x.i = p.k % p.h join k y on y.g = p.g and y.kind = p.kind and y.label = 1 and y.i = p.k % p.a""",
    "metrics_by_kind": metrics_sql("kind"),
    "metrics_overall": metrics_sql(""),
    "reliability_bins": f"select cast(bin as integer) as bin, count(*) as n, round(avg(p), 6) as mean_predicted, round(avg(y), 6) as observed from (select *, {BINS} as bin from {SCORED}) where bin is not null group by 1",
    "adaptive_calibration": f"select round(sum(m / n * abs(mp - my)), 6) as adaptive_ece, count(*) as bins from (select bin, count(*) as m, avg(p) as mp, avg(y) as my, max(n) as n from (select p, y, n, ((i + 1) * 10 - 1) // n as bin from (select p, y, row_number() over (order by p, md5(cast(doc_id as varchar))) - 1 as i, count(*) over () as n from {SCORED})) group by 1)",
    "fairness_slices": f"select slice, value, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg(((p >= 0.5)::int = y)::int), 6) as accuracy, round(avg(y), 6) as base_rate from (select y, p, 'kind' as slice, kind as value from {SCORED} union all select y, p, 'family', family from {SCORED} union all select y, p, 'lang', lang from {SCORED}) group by 1, 2 having count(*) >= 4",
    "coverage_curve": f"select cast(step as integer) as step, count(*) as n_kept, round(count(*) / (select count(*) from documents), 6) as coverage, round(avg(r), 6) as accuracy from (select greatest(p, 1 - p) as c, ((p >= 0.5)::int = y)::int as r from {SCORED}), (select unnest(range(10)) as step) where c >= 0.5 + step * 0.49 / 9 group by 1",
    "conformal_sets": f"""with s as (select y, p, case when y = 1 then 1 - p else p end as s from {SCORED}), n as (select count(*) as n from s), t as (select s as th from (select s, row_number() over (order by s) - 1 as i from s), n where i = ceil(least(1, ceil((n + 1) * 0.9) / n) * (n - 1) - 1e-9))
        select round(max(th), 6) as threshold, round(avg((1 - p <= th)::int + (p <= th)::int), 6) as mean_set_size, round(avg((case when y = 1 then 1 - p <= th else p <= th end)::int), 6) as coverage,
        round(avg(((1 - p <= th)::int + (p <= th)::int = 1)::int), 6) as singleton_rate, round(avg(((1 - p <= th)::int + (p <= th)::int = 2)::int), 6) as abstention_rate from s, t""",
    "selective_risk": f"select coverage, count(*) as n_kept, round(avg(wrong), 6) as risk, round(avg(sq), 6) as brier from (select (p - y) * (p - y) as sq, row_number() over (order by greatest(p, 1 - p) desc, md5(cast(doc_id as varchar))) as r, count(*) over () as n, ((p >= 0.5)::int <> y)::int as wrong from {SCORED}), (select unnest([0.5, 0.7, 0.8, 0.9, 0.95, 1.0])::double as coverage) where r <= greatest(1, ceil(coverage * n - 1e-9)) group by 1",
    "prevalence_metrics": f"select prevalence, round(sum(b * w), 6) as brier, round(sum(l * w), 6) as log_loss, round(sum(a * w), 6) as accuracy from (select prevalence, b, l, a, case when y = 1 then prevalence else 1 - prevalence end as w from (select y, avg((p - y) * (p - y)) as b, avg(-ln(case when y = 1 then greatest(1e-6, least(1 - 1e-6, p)) else 1 - greatest(1e-6, least(1 - 1e-6, p)) end)) as l, avg(((p >= 0.5)::int = y)::int) as a from {SCORED} group by 1), (select unnest([0.01, 0.1, 0.5])::double as prevalence)) group by 1",
    "transport_cells": f"with g as (select lang, count(*) as n, sum((p - y) * (p - y)) as sq, sum(((p >= 0.5)::int = y)::int) as ok from {SCORED} group by 1) select lang, n, round(sq / n, 6) as brier, round(ok / n, 6) as accuracy, round(sq / n - ((select sum(sq) from g) - sq) / ((select sum(n) from g) - n), 6) as brier_delta from g",
    "prior_grid": f"select doc_id, prevalence, round(lr * prevalence / (1 - prevalence) / (1 + lr * prevalence / (1 - prevalence)), 6) as posterior from (select doc_id, q / (1 - q) as lr from (select doc_id, greatest(1e-6, least(1 - 1e-6, p)) as q from {SCORED})), (select unnest([0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75])::double as prevalence)",
    "segment_dependence": f"""with s as (select doc_id, segment_no, ln(p / (1 - p)) as l from (select doc_id, segment_no, greatest(0.02, least(0.98, green / n_tokens)) as p from {SEGMENTS} where n_tokens >= 20)),
        e as (select doc_id, segment_no, l, l - avg(l) over (partition by doc_id) as e from s), f as (select *, lag(e) over (partition by doc_id order by segment_no) as f from e),
        g as (select doc_id, count(*) as n, sum(l) as naive, sum(e * f) as ef, sum(e * e) as ee from f group by 1), r as (select *, case when n >= 3 and ee > 1e-12 then greatest(0, least(1, ef / ee)) else 0 end as rho from g)
        select doc_id, n, round(naive, 6) as naive, round(rho, 6) as rho, round(naive / (1 + (n - 1) * rho), 6) as shrunk from r""",
    "overlap_corrected_odds": f"""with s as (select doc_id, segment_no * 128 as s, segment_no * 128 + n_tokens as e, ln(q / (1 - q)) as l from (select *, greatest(1e-6, least(1 - 1e-6, green / n_tokens)) as q from {SEGMENTS} where n_tokens >= 20)),
        t as (select doc_id, l, unnest(range(s, e)) as i from s), m as (select doc_id, i, avg(l) as l from t group by 1, 2) select doc_id, count(*) as tokens, round(avg(l), 6) as log_odds from m group by 1""",
    "family_geometry": """with e as (select vec_id, label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from embeddings), c as (select label as nearest, i, avg(v) as m from e group by 1, 2),
        d as (select e.vec_id, e.label, c.nearest, sum((v - m) * (v - m)) as d from e join c using (i) group by 1, 2, 3) select vec_id, label, arg_min(nearest, (d, nearest)) as nearest, round(sqrt(min(d)), 4) as distance from d group by 1, 2""",
    "group_weighting": "select doc_id, author, round(count(*) over () / ((select count(distinct author) from documents) * count(*) over (partition by author)), 6) as weight from documents where author is not null",
    "welch_prices": """with g as (select l_linestatus, count(*) filter (l_returnflag = 'R') as n1, count(*) filter (l_returnflag <> 'R') as n0, avg(l_extendedprice) filter (l_returnflag = 'R') as m1, avg(l_extendedprice) filter (l_returnflag <> 'R') as m0,
        var_samp(l_extendedprice) filter (l_returnflag = 'R') as v1, var_samp(l_extendedprice) filter (l_returnflag <> 'R') as v0 from lineitem group by 1)
        select l_linestatus, n1, n0, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t, round((v1 / n1 + v0 / n0) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v0 / n0) ^ 2 / (n0 - 1)), 6) as df, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) as cohens_d from g""",
    "mann_whitney_quantity": """with g as (select l_quantity as v, sum((l_returnflag = 'R')::int) as a, sum((l_returnflag <> 'R')::int) as b from lineitem group by 1), h as (select *, coalesce(sum(b) over (order by v rows between unbounded preceding and 1 preceding), 0) as below from g),
        s as (select sum(a) as n1, sum(b) as n0, sum(a * (below + b / 2)) as u, sum((a + b)::double ^ 3 - (a + b)) as ties from h)
        select n1::bigint as n1, n0::bigint as n0, round(u, 6) as u, round(1 - 2 * u / (n1::double * n0), 6) as rank_biserial, round((u - n1::double * n0 / 2) / sqrt(n1::double * n0 / 12 * (n1 + n0 + 1 - ties / ((n1::double + n0) * (n1 + n0 - 1)))), 6) as z from s""",
    "fdr_by_brand": """with g as (select p_brand, count(*) as n, sum((l_returnflag = 'R')::int) as k from lineitem join part on p_partkey = l_partkey group by 1), t as (select sum(k) / sum(n) as p0 from g), z as (select p_brand, (k / n - p0) / sqrt(p0 * (1 - p0) / n) as z from g, t),
        b as (select p_brand, z, exp(-z * z / 2) as b from z), r as (select *, count(*) over () / row_number() over (order by b) * b as q from b)
        select p_brand, round(z, 6) as z, round(b, 6) as bound, round(least(1, min(q) over (order by b desc range between unbounded preceding and current row)), 6) as q_value from r""",
    "mcnemar_counts": f"select a::bigint as only_a, b::bigint as only_b, round(case when a + b > 0 then greatest(0, abs(a - b) - 1) ^ 2 / (a + b) else 0 end, 6) as chi2 from (select sum((x and not w)::int) as a, sum((not x and w)::int) as b from (select (p >= 0.5)::int = y as x, (p >= 0.6)::int = y as w from {SCORED}))",
    "durbin_watson_prices": "with e as (select *, l_extendedprice - avg(l_extendedprice) over (partition by l_orderkey) as e from lineitem), d as (select e, e - lag(e) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as d from e) select round(sum(d * d) / sum(e * e), 6) as dw, count(*) as n from d",
    "jarque_bera_prices": "with m as (select l_returnflag, avg(l_extendedprice) as m from lineitem group by 1), g as (select l_returnflag, count(*) as n, avg((l_extendedprice - m) ^ 2) as m2, avg((l_extendedprice - m) ^ 3) as m3, avg((l_extendedprice - m) ^ 4) as m4 from lineitem join m using (l_returnflag) group by 1) select l_returnflag, n, round(m3 / m2 ^ 1.5, 3) as skew, round(m4 / m2 ^ 2 - 3, 3) as kurt, round(n / 6 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4), 3) as jb, round(exp(-n / 12 * ((m3 / m2 ^ 1.5) ^ 2 + (m4 / m2 ^ 2 - 3) ^ 2 / 4)), 3) as p_value from g",
    "first_events": "select event_type, count(distinct user_id) as users from events group by 1",
    "text_groups": f"select doc_id, substr(sha256({STRIPPED}), 1, 16) as \"group\" from documents join ({hygiene_sql('m4gt')}) using (doc_id) where reason = 'keep'",
    "source_names": r"""select doc_id, split_part(src, '_', 1) as domain,
        case when contains(src, '_machine_') then regexp_replace(src, '^.*?_machine_[^_]*_', '') when src like '%\_human' escape '\' then 'human' when src like '%\_human\_para' escape '\' then 'paraphrased_human'
            when contains(body, '_') then substr(body, strpos(body, '_') + 1) else 'unknown' end as family,
        case when contains(src, '_machine_') then regexp_extract(src, '_machine_([^_]*)', 1) when src like '%\_human' escape '\' then 'human' when src like '%\_para' escape '\' then 'paraphrase' else 'ood' end as prompt_mode,
        src like '%\_para' escape '\' and not contains(src, '_machine_') as paraphrased
        from (select *, regexp_replace(src, '_para$', '') as body from (select doc_id, case doc_id % 6 when 0 then source || '_machine_' || kind || '_' || family when 1 then source || '_human' when 2 then source || '_human_para' when 3 then source || '_' || family when 4 then source || '_' || family || '_para' else source end as src from documents))""",
    "version_pairs": f"""with r as (select {key('prompt_id')} as domain, coalesce(cohort_id, 'none') as version, label, text, record_id from {RECORDS} where text is not null and label in (0, 1)),
        k as (select *, row_number() over (partition by domain, version, label order by record_id) - 1 as i from r where domain is not null),
        x as (select h.domain, h.version, h.i, h.text as ht, a.text as mt from k h join k a on h.domain = a.domain and h.version = a.version and h.i = a.i and h.label = 0 and a.label = 1)
        select domain, version, cast(i as integer) as pair_no, label, case when label = 0 then 'human' else version end as family, domain || ':' || substr(sha256({STRIPPED.replace('text', 'ht')}), 1, 16) as "group", sha256({STRIPPED.replace('text', 't')}) as sha256
        from (select *, 0 as label, ht as t from x union all select *, 1, mt from x)""",
    "prompt_pair_groups": f"""with {PAIR_SIDES} select g as "group", kind, h::bigint as humans, a::bigint as ais, (h * a)::bigint as pairs from n""",
    "bootstrap_by_author": f"select replicate::int as replicate, round(brier, 6) as brier, round(accuracy, 6) as accuracy from {boot_sums('p')}",
    "bootstrap_intervals": " union all ".join(f"select '{m}' as metric, round((select {m} from {point_sql('p')}), 6) as point, round(quantile_cont({m}, 0.025), 6) as low, round(quantile_cont({m}, 0.975), 6) as high, count({m}) as n_boot from {b('p')}" for m, b in (("auroc", boot_auroc), ("brier", boot_sums), ("accuracy", boot_sums))),
    "paired_scores": " union all ".join(f"select '{m}' as metric, round((select {m} from {point_sql('p')}) - (select {m} from {point_sql('q')}), 6) as diff, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, round(least(1, 2 * least(avg((d <= 0)::int), avg((d >= 0)::int))), 6) as p_value, count(d) as n_boot from (select x.{m} - z.{m} as d from {b('p')} x join {b('q')} z using (replicate))" for m, b in (("auroc", boot_auroc), ("brier", boot_sums), ("accuracy", boot_sums))),
    "sliced_conformal": f"""with t as (select {higher('(select *, ' + NON + ' as s from ' + SCORED + ')', 's', LEVEL)} as th), x as (select ({NON} <= th)::int as ok, kind, family, lang from {SCORED}, t),
        l as (select 'pooled' as slice, 'all' as value, ok from x union all select 'kind', kind, ok from x union all select 'family', family, ok from x union all select 'lang', lang, ok from x)
        select slice, value, count(*) as n, round(avg(ok), 6) as coverage, round(avg(ok) - 0.9, 6) as gap from l group by 1, 2 having count(*) >= 30 or slice = 'pooled'""",
    "conformal_fit": f"""with c as (select y, {NON} as s from {CAL}) select k as class, round(coalesce(case k when 0 then {higher('(select * from c where y = 0)', 's', LEVEL)} else {higher('(select * from c where y = 1)', 's', LEVEL)} end, 1), 6) as threshold, (select count(*) from c) as n_calibration, 'mondrian' as method from (select unnest([0, 1]) as k)
        union all select k, round({higher('c', 's', LEVEL)}, 6), (select count(*) from c), 'pooled' from (select unnest([0, 1]) as k)""",
    "conformal_applied": f"""with c as (select y, {NON} as s from {CAL}), t as (select {higher('(select * from c where y = 0)', 's', LEVEL)} as t0, {higher('(select * from c where y = 1)', 's', LEVEL)} as t1),
        x as (select y, (1 - p <= t1)::int as a, (p <= t0)::int as b from {TEST}, t), z as (select y, a + b as k, case when y = 1 then a else b end as ok from x)
        select count(*) as n, round(avg(ok), 6) as coverage, round(avg(k), 6) as mean_set_size, round(avg((k = 1)::int), 6) as singleton_rate, round(avg((k = 2)::int), 6) as abstention_rate, round(avg((k = 0)::int), 6) as empty_rate, round(avg(case when y = 0 then ok end), 6) as coverage_0, round(avg(case when y = 1 then ok end), 6) as coverage_1 from z""",
    "fpr_thresholds": " union all ".join(f"select {f}::double as fpr, round(th, 6) as threshold, round(avg((p >= th)::int), 6) as tpr from {TEST}, (select {higher('(select * from ' + CAL + ' where y = 0)', 'p', str(1 - f))} as th) where y = 1 group by 1, 2" for f in (0.001, 0.01, 0.05)),
    "selective_thresholds": " union all ".join(f"select {c}::double as coverage, round(th, 6) as threshold, count(*) as n_kept, round(count(*) / (select count(*) from {TEST}), 6) as empirical_coverage, round(avg(((p >= 0.5)::int <> y)::int), 6) as risk, round(avg((p - y) * (p - y)), 6) as brier from {TEST}, (select {'0' if c == 1 else higher('(select greatest(p, 1 - p) as c from ' + CAL + ')', 'c', str(1 - c))} as th) where greatest(p, 1 - p) >= th group by 1, 2" for c in (1.0, 0.95, 0.9, 0.8, 0.7, 0.5)),
    "isotonic_calibration": f"select doc_id, round(greatest(1e-6, least(1 - 1e-6, fit)), 4) as calibrated from {SCORED} join {isotonic(SCORED)} using (p)",
    "calibration_bundle": f"""with f as (select p, fit from {isotonic(CAL)}), t as (select doc_id, p, (select max(f.p) from f where f.p <= t.p) as a, (select min(f.p) from f where f.p > t.p) as b from {TEST} t)
        select doc_id, round(greatest(1e-6, least(1 - 1e-6, case when a is null then fb.fit when b is null then fa.fit else fa.fit + (t.p - a) * (fb.fit - fa.fit) / (b - a) end)), 4) as calibrated from t left join f fa on fa.p = a left join f fb on fb.p = b""",
    "worst_language": f"select count(*) as groups, round(min(auroc), 6) as worst_auroc, round(max(brier), 6) as worst_brier, round(max(ece), 6) as worst_ece from ({metrics_sql('lang')}) where n >= 4 and auroc is not null",
    "hosmer_lemeshow": f"""with q as (select list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as q from {SCORED}),
        b as (select least(len(list_filter(q, lambda e: e <= p)), len(q) - 1) as bin, p, y from {SCORED}, q), g as (select bin, count(*) as n, sum(p) as e, sum(y) as o from b group by 1)
        select round(sum((o - e) ^ 2 / (e * (1 - e / n))), 4) as statistic, count(*) as bins, greatest(count(*) - 2, 1) as df from g""",
    "delong_scores": f"""with x as (select a.y, a.v as a, b.v as b from {placements('p')} a join {placements('q')} b using (doc_id)), g as (select y, count(*) as n, avg(a) as ma, avg(b) as mb, var_samp(a) + var_samp(b) - 2 * covar_samp(a, b) as v from x group by 1),
        z as (select max(ma) filter (y = 1) as auc_a, max(mb) filter (y = 1) as auc_b, sum(v / n) as v from g) select round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round((auc_a - auc_b) / sqrt(v), 6) as z, round(p, 6) as p_value
        from (select *, case when abs((auc_a - auc_b) / sqrt(v)) > 5.5 then 0.0 end as p from z)""",
    "segment_spans": f"""with k as (select doc_id, text, regexp_extract_all(text, '(?:{TOK})[\\s\\p{{Z}}]*') as k from documents where text is not null and coalesce(kind, 'text') <> 'code'),
        t as (select doc_id, len(k) as n, length(text) - list_sum(list_transform(k, lambda x: length(x))) as lead, k from k where len(k) > 0),
        o as (select doc_id, i, lead + coalesce(sum(length(w)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as a, length(regexp_replace(w, '[\\s\\p{{Z}}]+$', '')) as l from (select doc_id, lead, unnest(k) as w, unnest(range(len(k))) as i from t)),
        w as (select doc_id, n, unnest(range(greatest(cast(ceil((n - 160) / 128.0) as bigint), 0) + 1)) as j from t)
        select w.doc_id, cast(j + 1 as integer) as segment_no, cast(x.a as integer) as start, cast(y.a + y.l as integer) as end, cast(least(160, n - j * 128) as integer) as n_tokens from w join o x on x.doc_id = w.doc_id and x.i = j * 128 join o y on y.doc_id = w.doc_id and y.i = least(n, j * 128 + 160) - 1""",
    "fixture_scores": """select doc_id, round(0.08 + 0.84 * ((('0x' || substr(h, 1, 8))::bigint * 4294967296.0 + ('0x' || substr(h, 9, 8))::bigint) / 18446744073709551616.0 + case when contains(t, 'watermark positive') or contains(t, 'ai-generated') then 0.9 when contains(t, 'human-written') then 0.08 else 0.45 end) / 2, 6) as raw_score
        from (select doc_id, sha256(coalesce(text, '')) as h, lower(coalesce(text, '')) as t from documents)""",
    "author_majorities": "select author, cast(sum(label) * 2 >= count(*) as integer) as majority, count(*) as n from documents where author is not null group by 1",
    "author_holdout": """with g as (select author, row_number() over (order by sha256('13:holdout:' || author)) - 1 as i, count(*) over () as n from (select distinct author from documents where author is not null)), c as (select *, greatest(1, round_even(n * 0.2, 0)) as k from g)
        select author as "group", case when i < k then 'test' when i < 2 * k then 'calibration' else 'train' end as partition from c""",
    "cohort_cells": metrics_sql("cohort", f"(select * from (select *, lang || '|' || kind as cohort, count(*) over (partition by lang, kind) as c, min(y) over (partition by lang, kind) as a, max(y) over (partition by lang, kind) as b from {SCORED}) where c >= 30 and a < b)"),
    "pseudo_r2": f"""with g as (select sum(ln(case when y = 1 then greatest(1e-12, p) else 1 - least(1 - 1e-12, p) end)) as ll, avg(y) as r, count(*) as n, avg(p) filter (y = 1) as a, avg(p) filter (y = 0) as b from {SCORED}) select round(1 - ll / (n * (r * ln(r) + (1 - r) * ln(1 - r))), 6) as mcfadden, round(a - b, 6) as tjur from g""",
    "calibration_power": f"""with v as (select 'brier' as metric, var_samp((p - y) * (p - y)) as v from {SCORED} union all
            select 'ece', sum(m / c * (mp * (1 - mp) + my * (1 - my))) * (1 - 2 / pi()) from (select bin, count(*) as m, avg(p) as mp, avg(y) as my from (select *, {BINS} as bin from {SCORED}) where bin is not null group by 1), (select count(*) as c from {SCORED}))
        select metric, round(v, 6) as variance, e as effect, cast(ceil(7.848879734349086 * v / (e * e)) as bigint) as required_n from v, (select unnest([0.005, 0.01, 0.02, 0.05])::double as e)""",
    "green_bias": f"""select sum(n)::bigint as pairs, round(sum(case when g then n else 0 end) / sum(n), 6) as green_rate, round(2 * (sum(case when g then n else 0 end) / sum(n) - 0.5), 6) as strength from (select n, substr(sha256('demo-key::' || prev || '::' || t), 1, 1) < '8' as g
        from (select prev, t, count(*) as n from (select t, lag(t) over (partition by doc_id order by i) as prev from (select doc_id, unnest(k) as t, unnest(range(len(k))) as i from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{TOK}') as k from documents))) where prev is not null group by 1, 2))""",
    "story_groups": f"""with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from documents),
        t as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as t from w), f as (select doc_id, t, count(*) as tf from t group by 1, 2),
        v as (select t, ln((1 + (select count(*) from documents)) / (1.0 + count(*))) + 1 as idf from f group by 1 having count(*) >= 2 order by sum(tf) desc, t limit 60000),
        x as (select doc_id, t, (1 + ln(tf)) * idf as w from f join v using (t)), n as (select doc_id, t, w / sqrt(sum(w * w) over (partition by doc_id)) as w from x),
        e as (select a.doc_id as a, b.doc_id as b from n a join n b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2 having sum(a.w * b.w) >= 0.45), s as (select a, b from e union all select b, a from e),
        r as (select distinct a as v, a as l from s union select s.b, r.l from r join s on s.a = r.v)
        select l as cluster, count(*) as n from (select v, min(l) as l from r group by 1) group by 1""",
    "synonym_texts": f"""with k as (select doc_id, regexp_extract_all(coalesce(text, ''), '{TOK}') as k, coalesce(text, '') as t from documents), w as (select doc_id, unnest(k) as w, unnest(range(len(k))) as i from k),
        x as (select doc_id, i, w, regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]+') as word, case when regexp_full_match(w, '[\\p{{L}}\\p{{N}}_]+') and {U.format(x="'13:' || cast(doc_id as varchar) || ':' || cast(i as varchar)")} < 0.3 then coalesce(s.b, w) else w end as o from w left join (values {', '.join(f"('{a}', '{b}')" for a, b in SYNONYMS.items())}) s(a, b) on s.a = lower(w)),
        j as (select doc_id, string_agg(case when word and i > 0 then ' ' || o else o end, '' order by i) as t from x group by 1) select k.doc_id, sha256(coalesce(j.t, k.t)) as sha256 from k left join j using (doc_id)""",
    "run_manifests": f"""with recursive h as (select {key('run_id')} as run, sha256(text) as h from {RECORDS} where text is not null), g as (select run, count(*) as n, list_sort(list(h)) as a from h where run is not null group by 1),
        r as (select run, n, a from g union all select run, n, list_transform(range(1, (len(a) + 1) // 2 + 1), lambda i: sha256(a[2 * i - 1] || coalesce(a[2 * i], a[2 * i - 1]))) from r where len(a) > 1)
        select run, a[1] as merkle_root, cast(n as integer) as n_outputs from r where len(a) = 1""",
    "resolved_watermarks": """select provider, coalesce(watermark_status, case when late then 'suspected' else 'unknown' end) as status, case when watermark_status is null and late then case lower(trim(provider)) when 'mirelle' then 'scheme-x' else 'scheme-y' end end as scheme, count(*) as n
        from (select provider, watermark_status, coalesce(strftime(created_utc at time zone 'UTC', '%Y-%m-%d') >= case lower(trim(provider)) when 'mirelle' then '2026-03-01' when 'quince' then '2026-05-01' end, false) as late from runs) group by 1, 2, 3""",
    "auroc_interval": f"""with d as (select replicate, p, sum(m * pos) as pos, sum(m * neg) as neg from {draws(f'(select doc_id as "group", p, y as pos, 1 - y as neg from {SCORED})', 'p, pos, neg')} where m > 0 group by 1, 2), c as (select *, coalesce(sum(neg) over (partition by replicate order by p rows between unbounded preceding and 1 preceding), 0) as nb from d),
        b as (select replicate, sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) as a from c group by 1), g as (select p, sum(y) as pos, sum(1 - y) as neg from {SCORED} group by 1), h as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as nb from g)
        select round((select sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) from h), 6) as auroc, round(quantile_cont(a, 0.025), 6) as low, round(quantile_cont(a, 0.975), 6) as high, count(a) as n_boot from b""",
    "hourly_events": """select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as value from (select event_type, value, unnest([time_bucket(interval 30 minutes, t), time_bucket(interval 30 minutes, t) - interval 30 minutes]) as w from (select event_type, value, ts at time zone 'UTC' as t from events)) group by 1, 2""",
    "code_scores": f"select doc_id, round(raw_score, 6) as raw_score, abstain_reason from {CODE_SCORE}",
    "scrubbed_texts": "select doc_id, sha256(translate(regexp_replace(coalesce(text, ''), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{2060}\\x{AD}\\x{200E}\\x{200F}]', '', 'g'), '" + "".join(HOMOGLYPHS) + "', '" + "".join(HOMOGLYPHS.values()) + "')) as sha256 from documents",
    "dataset_fingerprint": "select sha256(count(*)::varchar || ':' || " + " || ':' || ".join(f"sum(('0x' || substr(h, {i * 12 + 1}, 12))::bigint)::varchar" for i in range(5)) + ") as dataset_hash from (select sha256(coalesce(text, '') || ' ' || coalesce(label::varchar, '')) as h from documents)",
    "model_windows": f"""with d as (select doc_id, coalesce(text, '') as text from documents), k as (select doc_id, text, regexp_extract_all(text, '(?:{TOK})[\\s\\p{{Z}}]*') as k from d),
        t as (select doc_id, text, len(k) as n, length(text) - coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) as lead, k from k),
        o as (select doc_id, i, lead + coalesce(sum(length(w)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as a, length(regexp_replace(w, '[\\s\\p{{Z}}]+$', '')) as l from (select doc_id, lead, unnest(k) as w, unnest(range(len(k))) as i from t)),
        w as (select doc_id, n, greatest(cast(ceil((n - 128) / 96.0) as bigint), 0) + 1 as m, unnest(range(least(32, greatest(cast(ceil((n - 128) / 96.0) as bigint), 0) + 1))) as j from t where n > 0)
        select w.doc_id, j::int as window_no, (j * 96)::int as token_start, least(n, j * 96 + 128)::int as token_end, x.a::int as char_start, (y.a + y.l)::int as char_end, (m <= 32)::int as covered from w join o x on x.doc_id = w.doc_id and x.i = j * 96 join o y on y.doc_id = w.doc_id and y.i = least(n, j * 96 + 128) - 1
        union all select doc_id, 0, 0, 0, 0, length(text), 1 from t where n = 0""",
    "balanced_view": f"""with b as (select quantile_cont(auroc, 0.025) as low, quantile_cont(auroc, 0.975) as high from {boot_auroc('p')}), r as (select avg(y) as r from {SCORED}), g as (select p, sum(y) as pos, sum(1 - y) as neg from {SCORED} group by 1), c as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as nb from g),
        v as (select unnest(['natural', 'balanced']) as view), s as (select view, (p - y) * (p - y) as b, -ln(case when y = 1 then greatest(1e-6, p) else 1 - least(1 - 1e-6, p) end) as l, ((p >= 0.5)::int = y)::int as a, case when view = 'natural' then 1 when y = 1 then 0.5 / r else 0.5 / (1 - r) end as w from {SCORED}, v, r)
        select view, round((select r from r), 4) as natural, round(sum(b * w) / sum(w), 4) as brier, round(sum(l * w) / sum(w), 4) as log_loss, round(sum(a * w) / sum(w), 4) as accuracy, round((select sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) from c), 4) as auroc, round((select low from b), 4) as low, round((select high from b), 4) as high from s group by 1""",
    "corpus_summary": f"""with r as (select * from {RECORDS}), f as {features_of('(select record_id as doc_id, text, kind, family, label from ' + RECORDS + ')')},
        c as (select family, kind, count(*) as n, count(distinct run_id) as runs, sum((b < 50)::int)::bigint as n_lt50, sum((b between 50 and 149)::int)::bigint as n_50_149, sum((b between 150 and 499)::int)::bigint as n_150_499, sum((b >= 500)::int)::bigint as n_500plus,
            ['declared-none', 'unknown', 'suspected', 'declared-active'][max(case watermark_status when 'declared-active' then 3 when 'suspected' then 2 when 'declared-none' then 0 else 1 end) + 1] as status from (select *, len({WORDS}) as b from r) group by 1, 2),
        g as (select family, kind, {', '.join(f'round({fn}({c}), 5) as {c}_{n}' for c in NAMES for n, fn in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} from f group by 1, 2) select * from c join g using (family, kind)""",
    "part_dependence": f"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents where kind = 'text' and text is not null), p as (select doc_id, unnest([0, 1, 2]) as i, w from w where len(w) >= 36),
        s as {prose_of("(select doc_id * 10 + i as doc_id, array_to_string(w[len(w) * i // 3 + 1 : len(w) * (i + 1) // 3], ' ') as text from p)")},
        l as (select doc_id // 10 as doc_id, doc_id % 10 as i, ln(q / (1 - q)) as l from (select doc_id, greatest(1e-6, least(1 - 1e-6, raw_score)) as q from s)), e as (select *, l - avg(l) over (partition by doc_id) as e from l), f as (select *, lag(e) over (partition by doc_id order by i) as f from e),
        g as (select doc_id, count(*) as n, sum(l) as naive, sum(e * f) as ef, sum(e * e) as ee from f group by 1), r as (select *, case when n >= 3 and ee > 1e-12 then greatest(0, least(1, ef / ee)) else 0 end as rho from g), d as (select doc_id, ln(q / (1 - q)) as document from (select doc_id, greatest(1e-6, least(1 - 1e-6, raw_score)) as q from {PROSE}))
        select count(*) as n_documents, round(avg(naive), 6) as mean_naive, round(avg(naive / (1 + (n - 1) * rho)), 6) as mean_shrunk, round(avg(document), 6) as mean_document, round(avg(rho), 6) as mean_rho, round(avg(abs(naive - document)), 6) as naive_vs_document from r join d using (doc_id)""",
    "mixture_curves": f"select rate, count(*) as n, round(avg(raw_score), 6) as mean_estimated, round(stddev_pop(raw_score), 6) as std_estimated, workflow from {mixtures("['ai_prefix', 'ai_suffix', 'interleave']")} group by rate, workflow",
    "mixture_tracking": f"select round(corr(rate, m), 4) as correlation, round(regr_slope(m, rate), 4) as slope, round(avg(abs(rate - m)), 4) as mae from (select rate, avg(raw_score) as m from {mixtures("['ai_prefix']")} group by 1)",
    "nested_author_folds": f"select fold, \"group\" as author, partition from {nested_sql('author')}",
    "protocol_partitions": f"""with g as (select author, row_number() over (order by sha256('13:holdout:' || author)) - 1 as i, count(*) over () as n from (select distinct author from documents where author is not null)), c as (select *, greatest(1, round_even(n * 0.2, 0)) as k from g)
        select 0 as fold, author as "group", case when i < k then 'test' when i < 2 * k then 'calibration' else 'train' end as partition, 'author' as unit from c union all select fold, "group", partition, 'family' from {nested_sql('family')}""",
    "stratified_authors": """with recursive g as (select concat_ws('|', source, label) as s, author as a, count(*) as c from documents where author is not null group by 1, 2),
        o as (select *, row_number() over (partition by s order by sha256('13:' || s || ':' || a)) as i, greatest(1, round_even(400.0 * sum(c) over (partition by s) / (select count(*) from documents), 0)) as q from g),
        r as (select distinct s, cast(0 as bigint) as i, cast(0 as bigint) as total, cast(null as varchar) as a, false as keep from g
            union all select o.s, o.i, total + case when total < q and (total = 0 or total + c <= q) then c else 0 end, o.a, total < q and (total = 0 or total + c <= q) from r join o on o.s = r.s and o.i = r.i + 1)
        select d.doc_id, d.author, d.source, d.label from documents d join r on r.keep and r.a = d.author and r.s = concat_ws('|', d.source, d.label)""",
    "calibration_transfers": f"select source, target, n, source = target as on_diagonal, {', '.join(f'round({c}, 4) as {c}' for c in ('brier', 'accuracy', 'auroc', 'auprc', 'ece', 'tpr_at_01fpr', 'tpr_at_1fpr', 'tpr_at_5fpr'))} from ({metrics_sql('source, target', transfers())})",
    "transfer_summary": f"select count(distinct source) as n_source_cohorts, round(avg(auroc) filter (source = target), 4) as on_auroc, round(avg(auroc) filter (source <> target), 4) as off_auroc, round(avg(brier) filter (source = target), 4) as on_brier, round(avg(brier) filter (source <> target), 4) as off_brier, round(avg(auroc) filter (source = target) - avg(auroc) filter (source <> target), 4) as auroc_gap from ({metrics_sql('source, target', transfers())})",
    "feature_correlations": " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 5) as r from {FEATURES}" for i, a in enumerate(X5) for b in X5[i + 1 :]),
}
SQL["operating_points"] = f"""select 'conformal' as block, point, value from (unpivot (select coverage, mean_set_size, singleton_rate, abstention_rate, empty_rate from ({SQL['conformal_applied']})) on coverage, mean_set_size, singleton_rate, abstention_rate, empty_rate into name point value value)
    union all select 'tpr_at_fpr', fpr::varchar, tpr from ({SQL['fpr_thresholds']}) union all select 'selective_risk', coverage::varchar, risk from ({SQL['selective_thresholds']})"""
