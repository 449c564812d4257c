"""DuckDB SQL for the queries that SQL can express, written apart from the operators' own code.

The others rest on a tokenizer, a 64-bit text hash, a parser or a fitted model, or return doubles
whose last bit depends on the order of a sum; tests hold them against brute force instead.
"""

from __future__ import annotations

from .mixing import HALVINGS, MAX_REPEAT, PASSES, SEED
from .urlfilter import RULES

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(l.b, v.vec_id)) AS component_id, v.vec_id <= coalesce(l.b, v.vec_id) AS kept
FROM v LEFT JOIN degree d ON v.vec_id = d.a LEFT JOIN least l ON v.vec_id = l.a"""


def _times(what: str) -> str:
    return f"(length(t) - length(replace(t, '{what}', ''))) // {len(what)}"


_CONTROL = ("\\", "<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>", "<</SYS>")
OP6 = f"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, role))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(role) + 4 + length('<|end|>') + length(t) + {" + ".join(_times(c) for c in _CONTROL)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _cut(rest: str, *marks: str) -> str:
    """Characters of a text before the first of the marks."""
    return "least(" + ", ".join(f"coalesce(nullif(strpos({rest}, '{m}'), 0) - 1, length({rest}))" for m in marks) + ")"


#: (host, path, query) of a url, by positions alone.
_PARTS = f"""rest AS (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS r FROM urls),
 hosted AS (SELECT u, translate(left(r, {_cut("r", "/", "?", "#")}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(r, {_cut("r", "/", "?", "#")} + 1) AS tail FROM rest),
 parts AS (SELECT u, host, left(tail, {_cut("tail", "?", "#")}) AS path, CASE WHEN strpos(left(tail, {_cut("tail", "#")}), '?') > 0 THEN substr(left(tail, {_cut("tail", "#")}), strpos(tail, '?')) ELSE '' END AS query FROM hosted)"""
_OWN = "(SELECT arg_max(struct_pack(rule := r.h || r.p, verdict := r.verdict), length(r.h) + length(r.p)) FROM rules r WHERE ({0}.host = r.h OR ends_with({0}.host, '.' || r.h)) AND starts_with({0}.path, r.p))"
#: Dot segments and base elements are not resolved here; no page of the tables has any.
OP7 = f"""WITH RECURSIVE rules(verdict, h, p) AS (VALUES {_RULES}),
 tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b.*?</script', ' ', 'g'), '(?is)<style\\b.*?</style', ' ', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
 hrefs AS (SELECT url, replace(trim(trim(CASE WHEN regexp_matches(tag, '(?is)^<link.*\\srel\\s*=\\s*["\\x27]?[^"\\x27>]*\\bcanonical\\b') THEN regexp_extract(tag, '(?is)\\shref\\s*=\\s*("[^"]*"|\\x27[^\\x27]*\\x27|[^\\s>]+)', 1)
   WHEN regexp_matches(tag, '(?is)^<meta.*\\shttp-equiv\\s*=\\s*["\\x27]?refresh') THEN regexp_extract(replace(tag, '&quot;', ''), '(?is)url\\s*=\\s*["\\x27]?([^"\\x27\\s>]+)', 1) ELSE '' END, '"' || chr(39))), '&amp;', '&') AS h FROM tags),
 page_urls AS (SELECT DISTINCT url AS u FROM pages WHERE url IS NOT NULL),
 targets AS (SELECT url, CASE WHEN h = '' OR starts_with(h, '#') THEN NULL WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h END
   WHEN starts_with(h, '//') THEN ':' || h WHEN starts_with(h, '/') THEN '://' || split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) || h
   WHEN starts_with(h, '?') THEN split_part(split_part(url, '#', 1), '?', 1) || h ELSE regexp_extract(split_part(split_part(url, '#', 1), '?', 1) || '/', '^(.*?://[^/]*/(?:.*/)?)[^/]*/?$', 1) || h END AS t FROM hrefs),
 urls AS (SELECT u FROM page_urls UNION SELECT t FROM targets WHERE t IS NOT NULL),
 {_PARTS},
 keyed AS (SELECT u, host, path, CASE WHEN path = '' THEN '/' ELSE path END AS plain, host || '|' || CASE WHEN path = '' THEN '/' ELSE path END || '|' || query AS key FROM parts),
 links AS (SELECT a.key AS x, b.key AS y FROM targets t JOIN keyed a ON a.u = t.url JOIN keyed b ON b.u = t.t WHERE a.host <> '' AND b.host <> '' AND a.key <> b.key),
 steps AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach(x, y) AS (SELECT x, y FROM steps UNION SELECT r.x, s.y FROM reach r JOIN steps s ON r.y = s.x),
 nodes AS (SELECT DISTINCT key, host, plain AS path FROM keyed), said AS (SELECT nodes.key, {_OWN.format("nodes")}.verdict AS verdict FROM nodes),
 spread AS (SELECT reach.x, CASE WHEN bool_or(said.verdict = 'allow') THEN 'allow' WHEN bool_or(said.verdict = 'block') THEN 'block' END AS verdict FROM reach JOIN said ON said.key = reach.y GROUP BY reach.x),
 own AS (SELECT keyed.*, {_OWN.format("keyed")} AS o FROM keyed)
SELECT pages.page_id, coalesce(own.host, '') AS host, coalesce(own.path, '') AS path, own.o.rule AS rule, coalesce(own.o.verdict, spread.verdict, 'allow') AS verdict
FROM pages LEFT JOIN own ON own.u = pages.url LEFT JOIN spread ON spread.x = own.key"""

OP9 = f"""WITH RECURSIVE tok AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
 src AS (SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS n FROM tok GROUP BY source),
 tot AS (SELECT sum(n) AS total, min(n) FILTER (n > 0) AS least FROM src),
 bis(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT b.k, b.lo, b.hi, any_value((b.lo + b.hi) / 2) AS mid, max(pow(t.least / t.total, (b.lo + b.hi) / 2)) / sum(pow(s.n / t.total, (b.lo + b.hi) / 2)) * max(t.total) / max(t.least) <= {MAX_REPEAT} AS fits
   FROM bis b, src s, tot t WHERE s.n > 0 AND b.k < {HALVINGS * PASSES} GROUP BY b.k, b.lo, b.hi)),
 alpha AS (SELECT CASE WHEN (SELECT max(1.0 / c) / max(least) * max(total) FROM tot, (SELECT count(*) AS c FROM src WHERE n > 0)) <= {MAX_REPEAT} THEN 0.0::DOUBLE ELSE (SELECT hi FROM bis WHERE k = {HALVINGS * PASSES}) END AS a),
 z AS (SELECT sum(pow(n / total, a)) AS z FROM src, tot, alpha WHERE n > 0),
 w AS (SELECT source, n, CASE WHEN n > 0 THEN pow(n / total, a) / z ELSE 0 END AS weight, total FROM src, tot, alpha, z),
 plan AS (SELECT source, weight, CASE WHEN n > 0 THEN CAST(floor(CAST(floor(weight * total + 0.5) AS BIGINT) / n) AS BIGINT) ELSE 1 END AS epochs, CAST(n AS BIGINT) AS n, CAST(floor(weight * total + 0.5) AS BIGINT) AS target FROM w),
 picked AS (SELECT t.doc_id, t.source, t.n_tokens, t.key, e.range AS epoch, p.weight FROM tok t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source, range(0, 64) e WHERE e.range < p.epochs
  UNION ALL SELECT doc_id, source, n_tokens, key, epochs, weight FROM (SELECT t.*, p.epochs, p.weight, p.n, p.target - p.epochs * p.n AS rest, sum(t.n_tokens) OVER (PARTITION BY t.source ORDER BY ('0x' || substr(md5('{SEED}|' || p.epochs || '|' || t.key), 1, 15))::BIGINT, t.key ROWS UNBOUNDED PRECEDING) AS upto
   FROM tok t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source) WHERE n > 0 AND rest > 0 AND upto <= rest)
SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, ('0x' || substr(md5('{SEED}|' || epoch || '|' || key), 1, 15))::BIGINT AS spot, round(weight, 9) AS weight FROM picked"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1, "op6_chat": OP6, "op7_url_filter": OP7, "op9_mixing": OP9}
