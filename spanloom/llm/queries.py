"""The ``opN_`` queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jump_sharding, kk_packing, license_scan, pii_crf, pq_negatives, prefix_trie, simhash, site_style, template_decon, toxicity, url_rules, voronoi, warc
from spanloom.llm.common import table


def capture_log(pages: DataFrame) -> DataFrame:
    """A web archive's records for the pages: each is captured in full and revisited up to three times.

    Page p is captured at minute p. It is revisited a day or more later with its entity tag and new
    dates; every fifth page once more after its tag has changed, every seventh before its capture.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    at = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    head = lambda *pairs: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in pairs])
    stored = head("ETag", tag, "Content-Type", "text/html", "Content-Length", F.length("html").cast("string"), "Cache-Control", "max-age=60", "Server", "a")
    same = head("etag", F.concat(F.lit("W/"), tag), "Content-Length", "0", "Cache-Control", "max-age=600", "Connection", "close")
    stale = head("ETag", '"changed"', "Server", "b")
    record = lambda name, kind, status, seconds, headers, payload: F.struct(
        F.concat(F.lit(f"{name}:"), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("kind"), F.lit(status).alias("status"),
        F.timestamp_seconds(seconds).alias("captured"), headers.alias("headers"), payload.alias("payload_digest"),
    )
    none = F.lit(None).cast("string")
    records = F.array(
        record("full", "response", 200, at, stored, digest),
        record("again", "revisit", 304, at + 86400 * (1 + F.col("page_id") % 3), same, none),
        F.when(F.col("page_id") % 5 == 0, record("stale", "revisit", 304, at + 200000, stale, none)),
        F.when(F.col("page_id") % 7 == 0, record("early", "revisit", 304, at - 30, same, none)),
    )
    return pages.select("url", F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("url", "r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the pages' capture log with the response it stands for."""
    found = warc.resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_text(F.col("headers")))


def op2_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score of every document."""
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``, with the shard if there were 17."""
    docs = table(spark, sf_dir, "documents")
    return jump_sharding.assign_shards(docs, "doc_id", "text", 16).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op4_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    found = voronoi.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return site_style.extract(table(spark, sf_dir, "pages"))


# The contract's rules: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL; URLs that no rule fits are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), "url", rules, ["page_id"])


def op7_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document, and those that the CRF adds."""
    return pii_crf.find(table(spark, sf_dir, "documents"))


def op9_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return kk_packing.pack(table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose templates it holds."""
    return template_decon.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_pq_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50; every seventh label is moved by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return pq_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0)


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_scan.label(table(spark, sf_dir, "documents"), license_scan.license_templates(spark))


def _template_values() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    rows = [(label, text, "true", 1.0) for label, text in license_scan.PHRASES] + [(label, text, "false", 0.8) for label, text in license_scan.NOTICES]
    return ", ".join(f"({quoted(label)}, {quoted(text)}, {base}, {least}::double)" for label, text, base, least in rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_knn_toxicity": op2_knn_toxicity,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_voronoi_topk": op4_voronoi_topk,
    "op5_site_style_tree": op5_site_style_tree,
    "op6_url_rules": op6_url_rules,
    "op7_simhash_variants": op7_simhash_variants,
    "op8_pii_crf": op8_pii_crf,
    "op9_kk_packing": op9_kk_packing,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_pq_hard_negatives": op12_pq_hard_negatives,
    "op13_license_diagonals": op13_license_diagonals,
}

ORACLES: dict[str, str] = {
    "op1_warc_revisits": r"""
        with p as (
            select page_id, url, html, md5(coalesce(html, '')) as digest, page_id * 60 as taken,
                '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag,
                regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest
            from pages
        ), q as (
            select *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                                            lambda x: x <> '' and not starts_with(x, 'utm_'))) as kept,
                regexp_extract(rest, '^[^/?]*([^?]*)', 1) as path
            from p
        ), c as (
            select *, regexp_replace(translate(regexp_extract(rest, '^[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)$', '')
                || (case when path = '' then '/' else path end)
                || (case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end) as url_key
            from q
        ), full_r as (
            select 'full:' || page_id as record_id, url_key, taken as seconds, tag, digest, length(html) as size from c
        ), revisit as (
            select 'again:' || page_id as record_id, url_key, taken + 86400 * (1 + page_id % 3) as seconds, tag from c
            union all select 'stale:' || page_id, url_key, taken + 200000, '"changed"' from c where page_id % 5 = 0
            union all select 'early:' || page_id, url_key, taken - 30, tag from c where page_id % 7 = 0
        ), matched as (
            select r.record_id, r.url_key, r.seconds, r.tag, f.record_id as target, f.seconds as target_at, f.tag as target_tag, f.digest, f.size,
                row_number() over (partition by r.record_id, r.url_key, r.seconds order by f.seconds desc, f.record_id desc) as n
            from revisit r left join full_r f on r.url_key = f.url_key and f.seconds < r.seconds
        )
        select record_id, url_key, seconds,
            case when target is null then 'no_earlier_response' when tag = target_tag then 'resolved' else 'validator_mismatch' end as outcome,
            case when tag = target_tag then target end as target_id,
            case when tag = target_tag then target_at end as target_seconds,
            case when tag = target_tag then digest end as payload_digest,
            case when tag = target_tag then
                'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10)
                || 'etag: W/' || tag || chr(10) || 'server: a' end as headers
        from matched where n = 1
    """,
    "op4_voronoi_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e
            from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, x.vec_id, cast(list_dot_product(q.e, x.e) as bigint) as score
            from v q join v x on q.vec_id % 20 = 0 and q.vec_id <> x.vec_id
        ), r as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s
        )
        select query_id, cast(n as int) as rank, vec_id, score from r where n <= 20
    """,
    "op6_url_rules": r"""
        with u as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
        ), p as (
            select page_id,
                coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
            from u
        ), r(h, d, v) as (
            values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), f as (
            select p.host, p.path, max(struct_pack(n := length(h || d), r := h || d, v := v)) as best
            from (select distinct host, path from p) p
            join r on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, d)
            group by p.host, p.path
        )
        select page_id, p.host, p.path, best.r as rule, coalesce(best.v, 'allow') as verdict
        from p left join f on p.host = f.host and p.path = f.path
    """,
    # Literal windows alone: equal to the templates' where no item holds a number, unit or name.
    "op10_template_decontamination": r"""
        with w as (
            select 'd' as side, doc_id as id, text from documents union all select 'i', item_id, text from benchmark
        ), t as (
            select side, id, list_filter(
                list_transform(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'),
                               lambda x: regexp_replace(x, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')),
                lambda x: x <> '') as words
            from w
        ), g as (
            select side, id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i+4], ' '))) as gram,
                generate_subscripts(range(1, greatest(len(words) - 4, 1) + 1), 1) as place, len(words) as size
            from t where len(words) > 0
        ), n as (select id as item_id, count(*) as windows from g where side = 'i' group by id),
        hit as (
            select d.id as doc_id, i.id as item_id, i.place, d.place - i.place as diagonal, i.size >= 5 as whole
            from g d join g i on d.side = 'd' and i.side = 'i' and i.gram = d.gram
            union all
            select d.id, i.id, 1, d.place, false
            from (
                select id, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i+k-1], ' '))) as gram,
                    generate_subscripts(range(1, len(words) - k + 2), 1) as place
                from t, (values (2), (3), (4)) w(k) where side = 'd' and len(words) > k
            ) d join g i on i.side = 'i' and i.size = d.k and i.gram = d.gram
        ), m as (select doc_id, item_id, count(distinct place) as matched from hit group by all),
        runs as (
            select doc_id, item_id, max(c) as longest from (
                select doc_id, item_id, diagonal, place - r as run, count(*) as c from (
                    select *, row_number() over (partition by doc_id, item_id, diagonal order by place) as r
                    from (select distinct doc_id, item_id, diagonal, place from hit where whole)) group by all) group by all
        )
        select doc_id, item_id, windows, matched, matched / windows as share
        from m join n using (item_id) left join runs using (doc_id, item_id) where matched / windows >= 0.8 - 1e-9 or longest >= 9
    """,
    "op11_conversation_trie": """
        with k as (
            select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
                lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
        ), c as (
            select conv_id, list(struct_pack(w := md5(coalesce(role, '')) || md5(coalesce(text, '')), n := strlen(coalesce(text, ''))) order by turn nulls first) as t
            from conversations where conv_id is not null group by conv_id
        ), h as (
            select conv_id, t, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
                lambda r, b: xor(r >> 8, crc[(xor(r, b) & 255) + 1])), 4294967295) % 9 as h
            from c, k
        ), r as (
            select h.conv_id, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) as t from h left join c b on b.conv_id = h.conv_id - h.conv_id % 5
        ), p as (
            select conv_id, len(t) as own, d, array_to_string(list_transform(t[1:d], lambda x: x.w), '') as node, case when d > 0 then t[d].n else 0 end as bytes
            from (select *, unnest(range(0, len(t) + 1)) as d from r)
        ), n as (
            select d, node, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where own = d), '')) as ends_sha256
            from p group by d, node
        ), kids as (select d - 1 as d, substr(node, 1, 64 * (d - 1)) as node, count(*) as n_children from n where d > 0 group by all),
        x as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (d, node)),
        up as (select *, unnest(range(0, d + 1)) as a from x),
        s as (
            select a as d, substr(node, 1, 64 * a) as node, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * bytes) as saved from up group by all
        )
        select x.conv_id, x.d as depth, up.conv_id as parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved::bigint as saved_tokens, x.ends_sha256
        from x join s using (d, node) left join n up on up.d = x.d - 1 and up.node = substr(x.node, 1, 64 * greatest(x.d - 1, 0))
    """,
    "op12_pq_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: floor(256 * x::double)) as e
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.vec_id as anchor_id, x.vec_id, a.label = x.label as alike, cast(list_dot_product(a.e, x.e) as bigint) as score
            from v a join v x on a.vec_id % 50 = 0
        ), p as (
            select anchor_id, vec_id, score from s where alike and anchor_id <> vec_id
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        ), n as (
            select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
                row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as n
            from p join s on p.anchor_id = s.anchor_id and not s.alike and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
        )
        select anchor_id, positive_id, cast(n as int) as rank, negative_id, positive_score, negative_score from n where n <= 3
    """,
    "op13_license_diagonals": r"""
        with given(label, text, is_base, threshold) as (values {templates}),
        t as (
            select row_number() over () as template, label, is_base, threshold, list_filter(
                string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                lambda x: x <> '') as w
            from given
        ), m as (
            select *, len(w) as size, case when len(w) >= 4 then 4 else least(len(w), 2) end as width,
                case when threshold >= 1 then 0 else floor(len(w) * (1 - threshold) / 2)::int end as slack
            from t
        ), g as (
            select *, array_to_string(w[place + 1:place + width], ' ') as gram from (select *, unnest(range(0, size - width + 1)) as place from m)
        ), d as (
            select row_number() over () as r, doc_id, list_filter(
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                lambda x: x <> '') as w
            from documents
        ), dg as (
            select r, width, i, array_to_string(w[i + 1:i + width], ' ') as gram
            from (select r, w, width, unnest(range(0, greatest(len(w) - width + 1, 0))) as i from d, (values (2), (4)) k(width))
        ), votes as (
            select distinct r, template, i - place as diagonal, place from dg join g using (width, gram)
        ), begun as (
            select r, template, diagonal, coalesce(diagonal - lag(diagonal) over (partition by r, template order by diagonal) > slack, true)::int as b
            from (select distinct r, template, diagonal from votes) join m using (template)
        ), merged as (
            select r, template, diagonal, sum(b) over (partition by r, template order by diagonal) as k from begun
        ), covered as (
            select r, template, k, unnest(range(place, place + width)) as p, diagonal from votes join merged using (r, template, diagonal) join m using (template)
        ), spans as (
            select r, template, k, least(count(distinct p), count(distinct p + diagonal)) as n, min(p + diagonal) as start from covered group by all
        ), s as (
            select r, label, is_base, start, n / size as share, n / size >= threshold as found from spans join m using (template)
        ), f as (
            select r, count(*) filter (where found and is_base) as n_base, min(start) filter (where found and is_base) as first_word,
                max(start) filter (where found and is_base) as last_word,
                string_agg(distinct label, ',' order by label) filter (where found and is_base) as base_labels,
                string_agg(distinct label, ',' order by label) filter (where found) as labels, max(share) as score
            from s group by r
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word,
            cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
        from d left join f using (r)
    """.replace("{templates}", _template_values()),
}
