"""The named queries in SQL, for another engine to check them by."""

from __future__ import annotations

from spanloom.operators.evaluate import threshold_grid
from spanloom.plans.queries import CORNERS, SWEEP

WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


ARTIFACTS = """
    a as (
        select cast(conv_id as varchar) as path, string_agg(text, chr(10) || chr(10) order by turn) as content
        from conversations where role = 'assistant' group by conv_id
    )"""

SOURCES = """
    s as (
        select cast(conv_id as varchar) as path, conv_id || ':' || turn as source_id, role || turn as uri, turn as uri_ord, text as content, role
        from conversations where role <> 'assistant'
    )"""


def spans(table: str = "a") -> str:
    return f"""
    ln as (
        select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from {table}
    ), mk as (
        select *, {trim("line")} = '' as blank,
            sum(length(regexp_replace(line, '[^{{\\[(]', '', 'g')) - length(regexp_replace(line, '[^}}\\])]', '', 'g')))
                over (partition by path order by n) as depth
        from ln
    ), fl as (
        select *, case when blank and depth <= 0 and not coalesce(lag(blank) over (partition by path order by n), true) then 1 else 0 end as fl from mk
    ), gr as (
        select *, coalesce(sum(fl) over (partition by path order by n rows between unbounded preceding and 1 preceding), 0) as gid from fl
    ), sp0 as (
        select path, gid, cast(min(n) as bigint) as start_line, cast(max(n) - max(fl) as bigint) as end_line,
            {trim("string_agg(line, chr(10) order by n) filter (where fl = 0)")} as text
        from gr group by path, gid
    ), sp as (select path, start_line, end_line, text from sp0 where text <> '')"""


def chunks(table: str, keys: str, marks: str = ".\\n;", least: int = 12, whole: str = "[content]") -> str:
    return f"""
    un as (
        select {keys}, content, list_filter(
            list_transform(string_split(regexp_replace(content, '([{marks}]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {trim("x")}),
            lambda u: length(u) > {least}) as u
        from {table}
    ), ch0 as (
        select {keys}, case when len(u) > 0 then list_transform(range(1, len(u) + 1), lambda i: array_to_string(u[i:i+1], ' ')) else {whole} end as c
        from un
    ), ch as (select {keys}, unnest(c) as chunk, cast(generate_subscripts(c, 1) - 1 as bigint) as chunk_ord from ch0)"""


def bag(table: str, keys: str, text: str) -> str:
    return f"""(
        select {keys}, t as token, count(*) as n
        from (select {keys}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}0-9]+'), lambda t: t <> '')) as t from {table})
        group by all)"""


RANKED = f"""
    with {ARTIFACTS}, {SOURCES}, {spans()}, {chunks("s", "path, source_id, uri, uri_ord")},
    st as {bag("sp", "path, start_line", "text")}, ct as {bag("ch", "path, source_id, uri, uri_ord, chunk_ord, chunk", "chunk")},
    sn as (select path, start_line, cast(sum(n * n) as double) as a from st group by all),
    cn as (select path, source_id, chunk_ord, cast(sum(n * n) as double) as b from ct group by all),
    dt as (
        select st.path, start_line, source_id, uri, uri_ord, chunk_ord, chunk, cast(sum(st.n * ct.n) as double) as dot
        from st join ct on st.path = ct.path and st.token = ct.token group by all
    ), sc as (
        select dt.*, dot / sqrt(a * b) as sim from dt join sn using (path, start_line) join cn using (path, source_id, chunk_ord)
    ), bs as (
        select * from (
            select *, row_number() over (partition by path, start_line, uri order by sim desc, uri_ord, chunk_ord) as r from sc) where r = 1
    ), pool as (
        select sp.path, sp.start_line, s.source_id, s.uri, s.uri_ord, coalesce(bs.sim, 0) as sim, bs.chunk
        from sp join s on sp.path = s.path left join bs on bs.path = sp.path and bs.start_line = sp.start_line and bs.uri = s.uri
    ), rk as (
        select *, row_number() over (partition by path, start_line order by sim desc, uri_ord) as rank from pool
    )"""

RESULTS = f"""{RANKED}, res as (
        select sp.path, sp.start_line, sp.end_line, sp.text,
            case when sim >= 0.45 then 'grounded' when sim >= 0.30 then 'uncertain' else 'ungrounded' end as status,
            case when sim >= 0.30 then source_id end as source_id, case when sim >= 0.30 then uri end as source_uri, uri as candidate_uri,
            greatest(coalesce(sim, -1), 0) as confidence, 'embedding' as method, chunk
        from sp left join rk on sp.path = rk.path and sp.start_line = rk.start_line and rk.rank = 1
    )"""

CITED = """, cit as (
        select case when conv_id % 5 = 0 then 'no' || conv_id else cast(conv_id as varchar) end as path,
            case when conv_id % 3 = 0 then 'nowhere' else 'user1' end as source_uri
        from (select distinct conv_id from conversations)
    ), dec as (
        select cit.path, cit.source_uri,
            case when a.path is not null and cit.source_uri = 'user1' then (select max(source_id) from s where uri = 'user1') end as source_id,
            a.path is not null as ok
        from cit left join a on cit.path = a.path
    )"""

DENSE = """
    q as (select vec_id as query_id, embedding as e, label from embeddings where vec_id % 5 = 0),
    p as (select vec_id, embedding as e, cast(label as varchar) as uri from embeddings where vec_id % 5 <> 0 and label <> 9),
    d as (
        select query_id, vec_id, uri, list_dot_product(cast(q.e as double[]), cast(p.e as double[])) as sim from q, p
    ), b as (
        select * from (select *, row_number() over (partition by query_id, uri order by sim desc, vec_id) as r from d) where r = 1
    ), k as (
        select *, row_number() over (partition by query_id order by sim desc, uri) as rank from b
    ), rec as (
        select q.query_id, case when label = 9 then 'UNGROUNDED' else cast(label as varchar) end as expected,
            e.rank as expected_rank, e.sim as expected_sim, k.uri as source, k.sim as sim
        from q join k on q.query_id = k.query_id and k.rank = 1
        left join k e on e.query_id = q.query_id and e.uri = case when label = 9 then 'UNGROUNDED' else cast(label as varchar) end
    )"""


DENSE_ALL = DENSE.replace(" and label <> 9", "")


def confusion(rows: str, keys: str, predicted: str, correct: str = "source = expected") -> str:
    by = f"{keys}, " if keys else ""
    return f"""
        select {by}tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall,
            round(f1, 6) as f1, round(fp / greatest(fp + tn, 1), 6) as false_attribution, round(ok / greatest(tp, 1), 6) as source_accuracy
        from (
            select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1 from (
                select *, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as r from (
                    select {by}count(*) filter (where {predicted} and expected <> 'UNGROUNDED') as tp,
                        count(*) filter (where {predicted} and expected = 'UNGROUNDED') as fp,
                        count(*) filter (where not ({predicted}) and expected <> 'UNGROUNDED') as fn,
                        count(*) filter (where not ({predicted}) and expected = 'UNGROUNDED') as tn,
                        count(*) filter (where {predicted} and expected <> 'UNGROUNDED' and {correct}) as ok
                    from {rows} {f"group by {keys}" if keys else ""})))"""


def values(numbers) -> str:
    return ", ".join(f"({n!r}::double)" for n in numbers)


BANDED = "(sim >= 0.10 and sim < 0.45)"
LISTED = "(expected <> 'UNGROUNDED' and coalesce(expected_rank <= 5 and expected_sim >= 0.10, false))"


def literal(text: str) -> str:
    """A string of any characters as SQL."""
    return " || ".join(f"chr({ord(c)})" for c in text) or "''"


corner_rows = ", ".join(f"('{path}', {literal(content)})" for path, content in CORNERS)

ORACLES: dict[str, str] = {
    "source_dedup": """
        select seq, uri, type, content_hash, session_id from (
            select doc_id as seq, 'doc:' || doc_id as uri, 'file' as type, sha256(text) as content_hash, source as session_id,
                row_number() over (partition by sha256(text), source order by doc_id) as r
            from documents) where r = 1""",
    "artifact_versions": """
        select event_id, path, content_hash, cast(row_number() over (partition by path order by ts) as bigint) as version from (
            select event_id, cast(user_id as varchar) as path, sha256(event_type) as content_hash, ts,
                lag(event_type) over (partition by user_id order by ts) as last, event_type
            from events) where last is null or last <> event_type""",
    "latest_artifact": """
        select path, event_id, content_hash, version from (
            select *, row_number() over (partition by path order by version desc) as r from (
                select event_id, path, content_hash, cast(row_number() over (partition by path order by ts) as bigint) as version from (
                    select event_id, cast(user_id as varchar) as path, sha256(event_type) as content_hash, ts,
                        lag(event_type) over (partition by user_id order by ts) as last, event_type
                    from events) where last is null or last <> event_type)) where r = 1""",
    "hook_route": """
        select * from (
            select event_id, case when event_type = 'purchase' then 'artifact' else 'source' end as target,
                case event_type when 'signup' then 'user' when 'error' then case when event_id % 2 = 0 then 'http://x/f' || event_id else 'web' end
                    when 'click' then case when event_id % 2 = 0 then 'Grep:p' else 'mcp__find:p' end
                    when 'view' then case when event_id % 5 <> 0 then 'f' || event_id end
                    else case when event_id % 3 < 2 then 'f' || event_id end end as uri,
                case event_type when 'signup' then 'user_msg' when 'error' then 'web' when 'click' then 'tool_result' when 'view' then 'file' end as type,
                case event_type when 'signup' then case when event_id % 6 <> 0 then 'ask f' || event_id end when 'purchase' then 'w' || props
                    else case when event_id % 4 <> 0 then 'answers on: ' || props end end as content,
                case when event_id % 7 <> 0 then cast(user_id as varchar) else 'unknown' end as session_id
            from events)
        where uri is not null and content is not null and not (target = 'source' and type = 'tool_result' and length(content) <= 20)""",
    "as_text": """
        select event_id, case event_id % 7 when 0 then '' when 1 then 's' || event_type when 2 then 'c' || event_type when 3 then 'o' || event_type
            when 4 then replace(props, ' ', '') when 5 then '["' || event_type || '",2]' else 't' end as txt
        from events""",
    "source_preview": f"""
        select conv_id, turn, substr(regexp_replace(text, '{WS}+', ' ', 'g'), 1, 60) as cli, substr(regexp_replace(text, '{WS}+', ' ', 'g'), 1, 80) as tool
        from conversations where role <> 'assistant'""",
    "sources_for_session": """
        select conv_id as session_id, turn as id, role, row_number() over (partition by conv_id order by turn) as place
        from conversations where role <> 'assistant'""",
    "segment_spans": f"""
        with {ARTIFACTS}, x as (select path, content from a union all select * from (values {corner_rows})), {spans("x")} select * from sp""",
    "chunk_windows": f"""
        with {SOURCES}, x as (select source_id as key, content from s union all select 'd' || doc_id, text from documents), {chunks("x", "key")}
        select key, chunk_ord, sha256(chunk) as chunk_hash from ch""",
    "token_vectors": f"""
        with t as {bag("documents", "doc_id", "text")}
        select doc_id, count(*) as tokens, cast(sum(n) as bigint) as total, cast(sum(n * n) as bigint) as norm from t group by doc_id""",
    "embed_cache_misses": """
        select distinct sha256(text) as content_hash, length(text) as n_chars from documents
        where text not in (select text from documents where doc_id % 2 = 0)""",
    "cosine_pairs": f"with {DENSE_ALL} select query_id, vec_id, round(sim, 6) as sim from d where sim >= 0.30",
    "best_per_source": f"with {DENSE_ALL} select query_id, uri, round(sim, 6) as sim, vec_id as cand_ord from b",
    "topk_candidates": f"with {DENSE_ALL} select query_id, rank, uri, round(sim, 6) as sim from k where rank <= 5",
    "decide_embedding": f"""
        {RESULTS} select path, start_line, end_line, status, source_uri, candidate_uri, round(confidence, 6) as confidence, method from res""",
    "top_candidates": f"""
        {RANKED} select path, start_line, rank - 1 as place, uri, round(sim, 6) as sim from rk where rank <= 5""",
    "judge_shortlist": f"""
        {RANKED} select path, start_line, rank, uri, round(sim, 6) as sim from (
            select *, max(case when rank = 1 then sim end) over (partition by path, start_line) as top from rk)
        where top >= 0.10 and top < 0.45 and sim >= 0.10 and rank <= 3""",
    "judge_decide": f"""
        {RANKED}, v as (
            select path, start_line, min(rank) as rank from (
                select rk.*, s.content, max(case when rank = 1 then sim end) over (partition by rk.path, start_line) as top
                from rk join s using (source_id))
            where top >= 0.10 and top < 0.45 and sim >= 0.10 and rank <= 3 and length(content) % 3 = 0 group by path, start_line
        ), w as (
            select v.path, v.start_line, rk.uri, case when length(content) % 2 = 0 then substr(content, 1, 10) else chunk end as evidence
            from v join rk using (path, start_line, rank) join s using (source_id)
        )
        select sp.path, sp.start_line, case when sim >= 0.45 or w.uri is not null then 'grounded' else 'ungrounded' end as status,
            case when sim >= 0.45 then rk.uri else w.uri end as source_uri, rk.uri as candidate_uri, round(greatest(coalesce(sim, -1), 0), 6) as confidence,
            case when {BANDED} then 'llm_judge' else 'embedding' end as method,
            sha256(case when sim >= 0.45 then chunk else w.evidence end) as evidence_hash
        from sp left join rk on sp.path = rk.path and sp.start_line = rk.start_line and rk.rank = 1
        left join w on w.path = sp.path and w.start_line = sp.start_line""",
    "parse_verdict": """
        select event_id, event_id % 6 in (0, 5) as derived, case event_id % 6 when 0 then 'e' || event_type when 5 then 'q' else '' end as evidence,
            true as available
        from events""",
    "counts": f"""
        {RESULTS} select (select count(*) from s) as sources, (select count(*) from a) as artifacts, (select count(*) from res) as links""",
    "declared_citation": f"""
        with {ARTIFACTS}, {SOURCES} {CITED}
        select path, source_uri, source_id, 1.0::double as confidence, 'declared' as method, ok,
            case when not ok then 'no artifact' when source_id is null then 'unknown source' end as reason
        from dec""",
    "why_line": f"""
        {RESULTS} select res.path, l.line, start_line, end_line, s.uri,
            case when role = 'user' then 'user_msg' when role is not null then 'conversation' end as type, round(confidence, 6) as confidence, method
        from res join (values (1::bigint), (2::bigint), (3::bigint), (99::bigint)) l(line) on l.line between start_line and end_line
        left join s on res.source_id = s.source_id""",
    "why_bulk": f"""
        {RESULTS}, li as (select path, unnest(range(1, len(string_split(content, chr(10))) + 2)) as line from a)
        select res.path, li.line, start_line, end_line, s.uri,
            case when role = 'user' then 'user_msg' when role is not null then 'conversation' end as type, round(confidence, 6) as confidence, method
        from res join li on res.path = li.path and li.line between start_line and end_line left join s on res.source_id = s.source_id""",
    "attribution_for": f"""
        {RESULTS} select path, start_line, end_line, 'block' as kind, source_uri as uri, round(confidence, 6) as confidence, method from res""",
    "replace_attribution": f"""
        {RESULTS} {CITED}
        select 'l' || path || ':' || start_line as id, 'link' as what from res where cast(path as bigint) % 2 <> 0
        union all select path || ':' || start_line, 'span' from res where cast(path as bigint) % 2 <> 0
        union all select 'lc' || path, 'link' from dec where ok union all select 'c' || path, 'span' from dec where ok""",
    "audit_coverage": f"""
        {RESULTS}, n as (
            select path, count(*) as spans, count(*) filter (where status = 'grounded') as grounded,
                count(*) filter (where status = 'uncertain') as uncertain, count(*) filter (where status = 'ungrounded') as ungrounded
            from res group by path)
        select *, cast(round(100 * grounded / spans) as bigint) as grounded_pct, cast(round(100 * uncertain / spans) as bigint) as uncertain_pct,
            cast(round(100 * ungrounded / spans) as bigint) as ungrounded_pct
        from n""",
    "gate": f"""
        {RESULTS}, n as (select path, count(*) as spans, count(*) filter (where status = 'ungrounded') as ungrounded from res group by path)
        select *, round(100 * (ungrounded / spans), 6) as ungrounded_pct, 100 * (ungrounded / spans) > 30 as failed from n""",
    "attestation_spans": f"""
        {RESULTS} select path, count(*) over (partition by path) as spans, count(*) filter (where status = 'grounded') over (partition by path) as grounded,
            row_number() over (partition by path order by start_line) - 1 as place, start_line, end_line, status, source_uri as source,
            round(confidence, 4) as confidence
        from res""",
    "split_hash": """
        with n as (
            select 'part' as kind, p_partkey as key, p_name as name from part union all select 'customer', c_custkey, c_name from customer
        ), h as (
            select kind, key, list_reduce(list_transform(string_split(name, ''), lambda x: unicode(x)::bigint),
                lambda h, c: (h * 31 + c) % 4294967296, 0::bigint) as h
            from n)
        select *, case when h % 5 < 2 then 'train' else 'test' end as split from h""",
    "expected_rank": f"""
        with {DENSE} select query_id, expected, expected_rank, round(expected_sim, 6) as expected_sim, source, round(sim, 6) as sim from rec""",
    "oracle_ceiling": f"""
        with {DENSE}, o as (select *, 'all' as set from rec)
        {confusion("o", "set", f"(sim >= 0.45 or ({BANDED} and {LISTED}))", f"(case when sim >= 0.45 then source = expected else {BANDED} and {LISTED} end)")}""",
    "eval_confusion": f"with {DENSE}, o as (select *, 'all' as set from rec) {confusion('o', 'set', 'sim >= 0.30')}",
    "threshold_sweep": f"""
        with {DENSE}, o as (select *, 'all' as set from rec, (values {values(SWEEP)}) t(threshold)) {confusion("o", "set, threshold", "sim >= threshold")}""",
    "calibrate_low": f"""
        with {DENSE}, o as (
            select *, 'all' as set from rec
            union all select query_id, expected, expected_rank, expected_sim, source, case when expected = 'UNGROUNDED' then sim * 0.6 else sim end, 'lowered' from rec
        ), g as (select * from o, (values {values(threshold_grid())}) t(threshold)), w as ({confusion("g", "set, threshold", "sim >= threshold")}),
        f as (select *, row_number() over (partition by set order by f1 desc, threshold desc) as r from w where false_attribution = 0)
        select o.set, coalesce(round(f.threshold, 2), 0.3) as low, coalesce(f.f1, 0) as f1
        from (select distinct set from o) o left join f on o.set = f.set and f.r = 1""",
    "judge_sweep": f"""
        with {DENSE}, o as (
            select rec.*, 'all' as set, model, case model when 'never' then false when 'always' then true else query_id % 2 = 0 end as derived
            from rec, (values ('never'), ('always'), ('even')) m(model))
        {confusion("o", "set, model", "(sim >= 0.45 or (sim >= 0.10 and derived))")}""",
    "label_alignment": f"""
        {RESULTS}, lb as (
            select distinct cast(conv_id as varchar) as path, case when turn % 4 = 3 then '~' || right(text, 15) else right(text, 15) end as find
            from conversations where role = 'assistant')
        select path, find, 'user1' as expected, start_line, source, coalesce(round(sim, 6), 0) as sim from (
            select lb.path, lb.find, start_line, candidate_uri as source, confidence as sim, row_number() over (partition by lb.path, lb.find order by start_line) as r
            from lb left join res on lb.path = res.path and contains(res.text, lb.find)) where r = 1""",
    "languages": "select count(distinct event_type) as languages from events",
    "spike_metrics": f"""
        with {DENSE} select 'all' as set, round(avg(case when expected <> 'UNGROUNDED' then cast(source = expected as int) end), 6) as top1,
            round(avg(cast((sim >= 0.35) = (expected <> 'UNGROUNDED') as int)), 6) as decided
        from rec""",
    "dataset_merge": """
        select uri, file_ord, ord, content_hash from (
            select 'u' || (doc_id % 500) as uri, doc_id % 3 as file_ord, doc_id as ord, sha256(text) as content_hash,
                row_number() over (partition by doc_id % 500 order by doc_id % 3, doc_id) as r
            from documents) where r = 1""",
    "stream_source_dedup": "select distinct sha256(event_type) as content_hash, cast(user_id as varchar) as session_id from events",
}
ORACLES |= {
    "decide_unscoped": f"""
        with {ARTIFACTS}, {SOURCES}, {spans()},
        z as (select source_id, source_id as uri, cast(path as bigint) * 1000 + uri_ord as uri_ord, content from s), {chunks("z", "source_id, uri, uri_ord")},
        st as {bag("sp", "path, start_line", "text")}, ct as {bag("ch", "source_id, uri, uri_ord, chunk_ord", "chunk")},
        sn as (select path, start_line, cast(sum(n * n) as double) as a from st group by all),
        cn as (select source_id, chunk_ord, cast(sum(n * n) as double) as b from ct group by all),
        dt as (
            select path, start_line, source_id, uri, uri_ord, chunk_ord, cast(sum(st.n * ct.n) as double) as dot from st join ct using (token) group by all
        ), sc as (select dt.*, dot / sqrt(a * b) as sim from dt join sn using (path, start_line) join cn using (source_id, chunk_ord)),
        bs as (select path, start_line, uri, max(sim) as sim from sc group by all),
        pool as (
            select sp.path, sp.start_line, z.uri, z.uri_ord, coalesce(bs.sim, 0) as sim
            from sp cross join z left join bs on bs.path = sp.path and bs.start_line = sp.start_line and bs.uri = z.uri
        ), rk as (select *, row_number() over (partition by path, start_line order by sim desc, uri_ord) as rank from pool)
        select sp.path, sp.start_line, sp.end_line,
            case when sim >= 0.45 then 'grounded' when sim >= 0.30 then 'uncertain' else 'ungrounded' end as status,
            case when sim >= 0.30 then uri end as source_uri, uri as candidate_uri, round(greatest(coalesce(sim, -1), 0), 6) as confidence
        from sp left join rk on sp.path = rk.path and sp.start_line = rk.start_line and rk.rank = 1""",
    "decide_dense": f"""
        with {ARTIFACTS}, {SOURCES}, {spans()}, {chunks("s", "path, source_id, uri, uri_ord")},
        tx as (select text from sp union select chunk from ch),
        vc as (
            select text, list_transform(c, lambda n: cast(n / greatest(sqrt(list_sum(list_transform(c, lambda m: cast(m * m as double)))), 1e-12) as float)) as v
            from (select text, list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda l: length(lower(text)) - length(replace(lower(text), l, ''))) as c from tx)
        ), sc as (
            select sp.path, start_line, uri, uri_ord, round(list_dot_product(cast(a.v as double[]), cast(b.v as double[])), 12) as sim
            from sp join ch on sp.path = ch.path join vc a on a.text = sp.text join vc b on b.text = ch.chunk
        ), bs as (select path, start_line, uri, max(sim) as sim, min(uri_ord) as uri_ord from sc group by all),
        rk as (select *, row_number() over (partition by path, start_line order by sim desc, uri_ord) as rank from bs)
        select sp.path, sp.start_line, sp.end_line,
            case when sim >= 0.95 then 'grounded' when sim >= 0.9 then 'uncertain' else 'ungrounded' end as status,
            case when sim >= 0.9 then uri end as source_uri, uri as candidate_uri, round(greatest(coalesce(sim, -1), 0), 6) as confidence
        from sp left join rk on sp.path = rk.path and sp.start_line = rk.start_line and rk.rank = 1""",
    "vector_dot": """
        select a.vec_id, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as sim
        from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "line_slices": f"""
        with {ARTIFACTS}
        select path, l.a, l.z, array_to_string((string_split(content, chr(10)))[greatest(l.a, 1):l.z], chr(10)) as lines
        from a, (values (1::bigint, 1::bigint), (0::bigint, 2::bigint), (3::bigint, 5::bigint)) l(a, z)""",
    "spike_spans": """
        select cast(p_partkey as varchar) as path, 'f' || p_partkey as name, 2::bigint as start_line, 4::bigint as end_line,
            sha256('export function f' || p_partkey || '(x) {' || chr(10) || '  return ' || p_size || chr(10) || '}') as text_hash
        from part
        union all select cast(p_partkey as varchar), 'g' || p_partkey, 6, 7, sha256('export function g' || p_partkey || '() {' || chr(10) || '  ' || p_brand) from part""",
    "spike_truth": """
        select 'f' || p_partkey as name, 2::bigint as start_line, case when p_partkey % 2 = 0 then p_brand else '?' end as expected from part
        union all select 'g' || p_partkey, 6, '?' from part""",
    "spike_chunks": f"""
        with x as (select doc_id, text as content from documents), {chunks("x", "doc_id", ".\\n", 15, "cast([] as varchar[])")}
        select doc_id, chunk_ord, sha256(chunk) as chunk_hash from ch""",
    "live_scores": f"""
        with {DENSE}, o as (
            select *, 'all' as set, query_id % 3 <> 0 and sim >= 0.30 as live from rec where query_id % 2 = 0)
        {confusion("o", "set", "live")}""",
    "live_lines": f"""
        with {DENSE}, o as (select *, query_id % 3 <> 0 and sim >= 0.30 as live, 'query ' || query_id as find from rec where query_id % 2 = 0)
        select query_id, rpad(find, cast(greatest(20, length(find)) as int), ' ') || ' ' || case when live then 'grounded   ' else 'ungrounded ' end || ' ' ||
            case when expected <> 'UNGROUNDED' then case when not live then 'missed' when source = expected then 'right' else 'wrong source' end
                when live then 'false attribution' else 'right' end as line
        from o""",
}
ORACLES["stream_route"] = ORACLES["hook_route"]
ORACLES["stream_versions"] = ORACLES["artifact_versions"]
ORACLES["stream_dedup_late"] = """
    with e as (
        select distinct sha256(event_type) as content_hash, cast(user_id as varchar) as session_id, (day(ts) - 1) // 6 as part from events where event_id % 7 <> 0
    ), k as (
        select content_hash, session_id, list_reduce(list_sort(list(part + 1)), lambda kept, p: case when p - kept % 10 > 3 then kept * 10 + p else kept end) as kept
        from e group by all
    )
    select content_hash, session_id, cast(unnest(list_transform(string_split(cast(kept as varchar), ''), lambda c: cast(c as int) - 1)) as bigint) as part from k"""
ORACLES["hook_source"] = f"select target, uri, type, content, session_id from ({ORACLES['hook_route']}) where type = 'file'"
ORACLES["hook_source_stream"] = f"select target, uri, type, content, session_id from ({ORACLES['hook_route']})"
ORACLES["sql_segment"] = ORACLES["segment_spans"]
ORACLES["sql_chunk"] = ORACLES["chunk_windows"]
ORACLES["sql_why"] = f"select path, line, start_line, end_line, uri, confidence, method from ({ORACLES['why_line']})"
ORACLES["store_attribution"] = f"""
    {RESULTS} select path, 2::bigint as version, start_line, end_line, source_uri as uri, round(confidence, 6) as confidence, method,
        case when cast(path as bigint) % 2 = 0 then status else 'first' end as status
    from res"""
ORACLES["store_vectors"] = """
    with t as (select sha256(text) as content_hash, length(text) as n, min(doc_id % 2) as odd, bool_or(doc_id % 3 = 0) as asked from documents group by all)
    select content_hash, case when odd = 0 then n else 1 end::double as first, case when odd = 0 then 1 else n end::double as second from t where asked"""
SEEDED = ORACLES["decide_unscoped"].replace(
    "as uri_ord, content from s)", "as uri_ord, content from s qualify row_number() over (partition by content order by cast(path as bigint) * 1000 + uri_ord) = 1)"
)
ORACLES["eval_seeded"] = f"""
    with {ARTIFACTS}, {spans()}, d as (select * from ({SEEDED})), lb as (
        select distinct cast(conv_id as varchar) as path, right(text, 15) as find, conv_id || ':0' as expected from conversations where role = 'assistant'
    ), al as (
        select lb.*, sp.start_line, row_number() over (partition by lb.path, find order by sp.start_line) as r
        from lb left join sp on lb.path = sp.path and contains(sp.text, lb.find)
    ), o as (
        select 'all' as set, expected, coalesce(confidence, 0) as sim, candidate_uri as source from al left join d using (path, start_line) where r = 1
    )
    {confusion("o", "set", "sim >= 0.45")}"""
ORACLES["attestation_verify"] = """
    select cast(conv_id as varchar) as path, document, document = 'signed' as valid
    from (select distinct conv_id from conversations where role = 'assistant'), (values ('signed'), ('altered'), ('forged')) d(document)"""
