"""SQL that checks this subpackage's queries, where SQL can express them."""

from __future__ import annotations

# Keys as they are compared: no outer blanks, no case; blank is null.
KEY = "nullif(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"
_TOKEN = r"(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}])[\s\p{Z}]*"

_WORDS = "regexp_extract_all(lower(nfc_normalize({})), '[\\p{{L}}\\p{{N}}]+')"
_LETTERS = f"array_to_string({_WORDS}, '')"
_COUNT = f"len({_WORDS})"
# Records with at least 30 words: letters and digits in order, and the named fields in sorted order, of lines
# or of a flat JSON object.
_FORMS = f"""t as (select distinct record_id, text, lower(trim(split)) as split from corpus_records where text is not null and {_COUNT.format('text')} >= 30),
        o as (select record_id, text, json_keys(text) as k from t where json_valid(text) and json_type(case when json_valid(text) then text end) = 'OBJECT'),
        jf as (select record_id, list_sort(list({_LETTERS.format('name')} || chr(1) || {_LETTERS.format('v')})) as f from (select record_id, name, json_extract_string(text, '$."' || name || '"') as v, json_type(text, '$."' || name || '"') as ty from (select record_id, text, unnest(k) as name from o)) group by record_id having count(*) > 1 and bool_and(ty not in ('OBJECT', 'ARRAY'))),
        l as (select record_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) as line from t where record_id not in (select record_id from o)),
        lf as (select record_id, list_sort(list({_LETTERS.format("split_part(line, ':', 1)")} || chr(1) || {_LETTERS.format("substr(line, strpos(line, ':') + 1)")}) filter (contains(line, ':'))) as f from l group by record_id
            having count(*) filter (contains(line, ':')) > 1 and bool_and(case when contains(line, ':') then {_COUNT.format("split_part(line, ':', 1)")} between 1 and 8 else {_COUNT.format('line')} = 0 end)),
        c as (select record_id, split, {_LETTERS.format('text')} as plain, cast(coalesce(jf.f, lf.f) as varchar) as fields from t left join jf using (record_id) left join lf using (record_id)),
        e as (select distinct 'p' || plain as x, 'f' || fields as y from c where fields is not null), b as (select x, y from e union select y, x from e),
        reach as (select distinct x as node, x as root from b union select b.y, r.root from reach r join b on b.x = r.node),
        m as (select node, min(root) as root from reach group by 1), cls as (select record_id, split, coalesce(root, 'p' || plain) as class from c left join m on m.node = 'p' || plain)"""

SQL: dict[str, str] = {
    "p5_found": f"with recursive {_FORMS} select low as first_record_id, record_id from (select record_id, min(record_id) over (partition by class) as low from cls) where record_id <> low",
    "p6_found": f"""with recursive {_FORMS}, s as (select record_id, split = 'train' as train, {_WORDS.format('text')} as w from t where split in ('train', 'development', 'calibration', 'test')),
        g as (select distinct record_id, train, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select record_id, train, w, unnest(range(1, len(w) - 1)) as i from s)), n as (select record_id, count(*) as n from g group by 1),
        p as (select a.record_id as a, b.record_id as b, count(*) as k from g a join g b on a.g = b.g and not a.train and b.train group by 1, 2),
        near as (select a, b from p join n x on x.record_id = a join n y on y.record_id = b where k >= 0.6 * (x.n + y.n - k)),
        same as (select a.record_id as a, b.record_id as b from cls a join cls b on a.class = b.class and a.split in ('development', 'calibration', 'test') and b.split = 'train')
        select distinct least(a, b) as record_id_a, greatest(a, b) as record_id_b from (select * from near union select * from same)""",
    "p1_found": f"""with recursive c as (select distinct {KEY.format('run_id')} as run, nullif(lower(ltrim(regexp_replace(contributor, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '@')), '') as who from runs),
        r as (select distinct record_id, cohort_id, {KEY.format('run_id')} as run, {KEY.format('prompt_id')} as prompt from corpus_records),
        k as (select record_id, cohort_id, 'run ' || run as node from r join split_manifest using (cohort_id) where group_unit like '%run_id%' and run is not null
            union select record_id, cohort_id, 'prompt ' || prompt from r join split_manifest using (cohort_id) where group_unit like '%prompt_id%' and prompt is not null
            union select record_id, cohort_id, 'who ' || who from r join split_manifest using (cohort_id) join c using (run) where group_unit like '%contributor%' and who is not null),
        e as (select distinct a.cohort_id, a.node as x, b.node as y from k a join k b using (record_id, cohort_id)),
        t as (select cohort_id, x, y from e union select t.cohort_id, t.x, e.y from t join e on e.cohort_id = t.cohort_id and e.x = t.y),
        m as (select cohort_id, x as node, min(y) as root from t group by 1, 2),
        g as (select distinct cohort_id, record_id, root from k join m using (cohort_id, node)),
        f as (select record_id, min(record_id) over (partition by cohort_id, root) as first_record_id from g)
        select first_record_id, record_id from f where record_id <> first_record_id""",
    "p3_found": f"""with k as (select record_id, regexp_extract_all(text, '{_TOKEN}') as k from (select distinct record_id, text from corpus_records where text is not null)),
        b as (select record_id, len(k) as n, list_filter(range(1, len(k)), lambda i: regexp_matches(k[i], '[\\r\\n]') or (k[i][1] in ('.', '!', '?') and len(k[i]) > 1)) as cuts from k),
        w as (select distinct record_id, window_no, greatest(coalesce(token_start, 0), 0) as s, least(coalesce(token_end, n), n) as e, cuts from token_windows join b using (record_id)),
        g as (select record_id, window_no, list_concat([s], list_filter(cuts, lambda c: c > s and c < e), [e]) as g from w where e - s > 256)
        select distinct record_id, window_no, case when list_max(list_transform(range(1, len(g)), lambda i: g[i + 1] - g[i])) > 256 then 'forced' else 'boundary' end as cut from g""",
}
