"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op8_exact_dedup"] = r"""
with rows as (
    select doc_id, length(coalesce(text, '')) points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') content
    from documents),
ranked as (
    select doc_id, content,
           first_value(doc_id) over (partition by content order by points desc, doc_id) keep_id,
           count(*) over (partition by content) group_size
    from rows)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(content) as text_sha256 from ranked
"""

ORACLES["op10_url_filter"] = r"""
with recursive parts as (
    select page_id, url, html,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path
    from pages),
rules(action, rule_host, rule_path) as (
    values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits as (
    select page_id, url, action, rule_host || rule_path as rule,
           row_number() over (partition by page_id order by length(rule_host || rule_path) desc) k
    from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)),
own as (select page_id, url, action, rule from fits where k = 1),
links as (
    select url a, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']([^"''>]*)', 1) b from pages
    union all
    select url, regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*([^"''>]+)', 1) from pages),
both_ways as (select a, b from links where b like '%://%' union select b, a from links where b like '%://%'),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
carried as (
    select r.a url, case when bool_or(o.action = 'allow') then 'allow' else 'block' end verdict
    from reach r join own o on o.url = r.b group by 1)
select p.page_id, p.host, p.path, o.rule, coalesce(o.action, c.verdict, 'allow') as verdict
from parts p left join own o using (page_id) left join carried c on c.url = p.url
"""

ORACLES["op3_minhash"] = r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') w
    from documents),
shingles as (
    select distinct doc_id, array_to_string(w[k : k + 3], ' ') s
    from words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as t(k) where len(w) > 0),
sizes as (select doc_id, count(*) n from shingles group by 1),
common as (
    select x.doc_id a, y.doc_id b, count(*) both_have
    from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
links as (
    select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * both_have >= 80 * (p.n + q.n - both_have)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
least as (select a, min(b) b from reach group by 1)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
       d.doc_id <= coalesce(l.b, d.doc_id) as kept
from documents d left join sizes s using (doc_id) left join least l on l.a = d.doc_id
"""

ORACLES["op7_embedding_dedup"] = r"""
with recursive usable as (
    select vec_id, label, embedding::double[] v from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select x.vec_id a, y.vec_id b from usable x join usable y on x.label = y.label and len(x.v) = len(y.v) and x.vec_id < y.vec_id
    where list_cosine_similarity(x.v, y.v) >= 0.98),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
least as (select a, min(b) b from reach group by 1),
degree as (select a, count(*) n from both_ways group by 1)
select e.vec_id, coalesce(d.n, 0) as n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) as component_id,
       e.vec_id <= coalesce(l.b, e.vec_id) as kept
from embeddings e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""

ORACLES["op6_chat"] = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked as (
    select *, replace(replace(role, '\', '\\'), chr(10), '\n') as role_shown from rows),
joined as (
    select conv_id, count(*) n_turns,
           string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) turns,
           coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') loss,
           sum(length('<|im_start|>') + length(role_shown) + len(regexp_extract_all(role_shown, '<\\*\|')) + 1
               + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) formatted_chars
    from marked group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       formatted_chars::bigint as formatted_chars
from joined
"""


def _licenses() -> str:
    from .licenses import COMMON, TEMPLATES

    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(t)})" for k, (n, t) in enumerate(TEMPLATES))
    word = "'[a-z0-9.]*[a-z0-9]'"
    common = ", ".join(quote(w) for w in COMMON.split())
    return f"""
with recursive templates(template, license, body) as (values {rows}),
bags as (select template, license, unnest(regexp_extract_all(lower(body), {word})) token from templates),
counted as (select template, license, token, count(*)::double tf from bags group by 1, 2, 3),
idf as (
    select token, ln((1 + (select count(*) from templates))::double / (1 + count(*))) + 1 as idf from counted where token not in ({common}) group by 1
    union all select unnest([{common}]), 1.0::double),
raw as (select *, tf * idf as x from counted join idf using (token)),
units as (select template, license, token, x / sqrt(sum(x * x) over (partition by template)) as weight from raw),
files as (
    select doc_id, concat_ws('/', source, (doc_id // 1000)::varchar, (doc_id // 10)::varchar) as dir,
           concat_ws('/', source, (doc_id // 1000)::varchar, (doc_id // 10)::varchar, case when doc_id % 10 = 0 then 'LICENSE' else doc_id || '.txt' end) as path,
           coalesce(text, '') as text from documents),
cut as (select path, string_split(text, chr(10)) l from files),
spans as (
    select path, l, i as k, w from cut, unnest(range(1, len(l) + 1)) as t(i), (values (1), (2), (3)) v(w) where i + w - 1 <= len(l)
    union all select path, l, 1, len(l) from cut where path like '%/LICENSE'),
parts as (select path, (k, w) as k, array_to_string(l[k : k + w - 1], ' ') as line from spans),
words as (select path, k, token, count(*)::double tf from (select path, k, unnest(regexp_extract_all(lower(line), {word})) token from parts) group by 1, 2, 3),
weighed as (select path, k, token, tf * coalesce(idf, ln(1 + (select count(*) from templates)) + 1) as x from words left join idf using (token)),
norms as (select path, k, sqrt(sum(x * x)) norm from weighed group by 1, 2),
scores as (
    select path, license, round(sum(x * weight) / any_value(norm), 6) score
    from weighed join units using (token) join norms using (path, k) group by path, k, template, license),
own as (select path, license, score from (select *, row_number() over (partition by path order by score desc, license) r from scores where score >= 0.6) where r = 1),
licensed as (select dir, license from (select f.dir, o.license, row_number() over (partition by f.dir order by o.score desc, o.license, o.path) r
    from own o join (select distinct path, dir from files) f using (path) where path like '%/LICENSE') where r = 1),
dirs as (select distinct dir from files),
near as (select d.dir, l.license, l.dir as up, row_number() over (partition by d.dir order by length(l.dir) desc) r
    from dirs d join licensed l on d.dir = l.dir or starts_with(d.dir, l.dir || '/'))
select f.doc_id, f.path, coalesce(o.license, n.license) as license, o.score,
       case when o.license is not null then 'own' when n.license is not null then 'inherited' else 'none' end as basis,
       case when o.license is null then n.up end as from_directory
from files f left join own o using (path) left join (select * from near where r = 1) n on n.dir = f.dir
"""


ORACLES["op4_licenses"] = _licenses()

ORACLES["op12_warc"] = r"""
with rows as (
    select page_id, url, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) payload_bytes, sha1(coalesce(html, '')) hex from pages),
digests as (
    select hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> (15 - 5 * d)) & 31)::int + 1, 1), '' order by g, d) as payload_digest
    from (select hex, g, ('0x' || substr(hex, 5 * g + 1, 5))::bigint n from (select distinct hex from rows), unnest(range(8)) t(g)), unnest(range(4)) s(d)
    group by hex),
largest as (select *, max(page_id) over (partition by html) best from rows)
select page_id, payload_bytes, payload_digest, case when page_id < best then 'revisit' else 'response' end as record_type,
       case when page_id < best then best end as refers_to,
       coalesce(array_to_string(list_reverse(string_split(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '.')), ',') || ')'
           || regexp_replace(url, '(?s)^.*?://[^/?#]*', ''), '') as url_key
from largest join digests using (hex)
"""


def _centroids() -> str:
    from .centroids import CLUSTERS, DIM, ROUNDS, SCALE, SEED

    def assigned(k: int) -> str:
        return f"""a{k} as materialized (
    select r, min(distance) distance, arg_min(cluster, distance * 1000 + cluster) as cluster from (
        select r, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint distance
        from kept, c{k}) group by r)"""

    rounds = ", ".join(f"""{assigned(k)},
entries{k} as (select cluster, i, sum(x[i])::hugeint s, count(*)::hugeint n from a{k} join kept using (r), unnest(range(1, {DIM + 1})) t(i) group by 1, 2),
c{k + 1} as materialized (
    select c{k}.cluster, coalesce(m.c, c{k}.c) as c from c{k}
    left join (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) c from entries{k} group by 1) m using (cluster))""" for k in range(ROUNDS))
    return f"""
with kept as materialized (
    select vec_id, row_number() over () r, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) x from embeddings
    where embedding is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
c0 as materialized (
    select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, x) - 1 as cluster, x as c from kept
    qualify cluster < {CLUSTERS}),
{rounds}, {assigned(ROUNDS)}
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
       sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} join kept using (r) join c{ROUNDS} using (cluster)
"""


ORACLES["op13_centroids"] = _centroids()
