"""The results of those opN_ queries that SQL can state, as DuckDB runs it over the tables' views.

Not stated: op1 (token ids), op4 (a parser), op6 (trained weights), op7 (Spark's seeded hash), op9 (CRC-32 of whole texts) and op11 (eigenvectors).
"""

from __future__ import annotations

import re

from loomwright.llm import secrets

#: Letters in either case without a flag, which would also match two letters beyond ASCII.
_ASSIGN = re.sub(r"\(\?i:\((.*?)\)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", secrets.ASSIGN)


def _kind(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, owner, repository, {rank} AS rank, '{kind}' AS kind, start, start + n AS stop, value FROM (
  SELECT r, owner, repository, value, n, sum(gap + n) OVER (PARTITION BY r ORDER BY i) - n AS start FROM (
    SELECT r, owner, repository, unnest(vs) AS value, length(unnest(fs)) AS n, length(unnest(gs[1:len(fs)])) AS gap, unnest(range(len(fs))) AS i FROM (
      SELECT r, owner, repository, regexp_extract_all(t, '{quoted}') AS fs, regexp_extract_all(t, '{quoted}', {group}) AS vs, regexp_split_to_array(t, '{quoted}') AS gs FROM d)))
  WHERE length(value) >= {least}"""


_KINDS = [(k, _ASSIGN if k == "assign" else p, g, n, rank) for rank, (k, p, g, n) in enumerate(secrets.KINDS)]
_TOLD = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"

ORACLE: dict[str, str] = {
    "op2_secret_scan": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({" UNION ALL ".join(_kind(*k) for k in _KINDS[:3])}),
further AS (SELECT * FROM ({_kind(*_KINDS[3])}) o WHERE len(list_distinct(string_split(value, ''))) >= {secrets.VARIED} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.start < o.stop AND o.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM further),
counts AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM every GROUP BY value),
kept AS (SELECT every.*, owners, repositories FROM every JOIN counts USING (value) WHERE kind <> 'owned' OR owners = 1),
told AS (SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h, {_TOLD} FILTER (kind <> 'owned') AS b, {_TOLD} AS s,
  count(*) FILTER (owners = 1) AS live, count(*) FILTER (owners >= {secrets.WIDE} OR repositories >= {secrets.WIDE_REPOSITORIES}) AS example, max(repositories) AS most FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans, coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example, coalesce(most, 0) AS most_repositories FROM d LEFT JOIN told USING (r)""",
    "op3_suffix_array_dedup": """WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, doc_id, j, substr(h, 1024 * j + 1, 1024 + 98) AS h, least(512, length(h) // 2 - 512 * j) AS n FROM (SELECT *, unnest(range((length(h) + 1023) // 1024)) AS j FROM b)),
x AS (SELECT r, doc_id, j, h, unnest(range(n)) AS o FROM p),
y AS (SELECT r, doc_id, 512 * j + o AS i, substr(h, 2 * o + 1, 2) AS byte, CASE WHEN 2 * o + 100 <= length(h) THEN md5_number(substr(h, 2 * o + 1, 100)) END AS k FROM x),
m AS (SELECT k, min(doc_id) AS least FROM y WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) > 1),
z AS (SELECT r, i, byte, coalesce(max(least < doc_id) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM y LEFT JOIN m ON y.k = m.k),
v AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY r ORDER BY i) AS begins FROM z),
t AS (SELECT r, count(*) FILTER (gone) AS removed, count(*) FILTER (begins) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM v GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM b LEFT JOIN t USING (r)""",
    "op5_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 11, 1)), lambda i: array_to_string(ws[i:i + 12], ' '))) AS k, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
m AS (SELECT k, min(doc_id) AS d FROM x GROUP BY k),
gone AS (SELECT DISTINCT x.doc_id, x.i + j.j AS i FROM x JOIN m USING (k) CROSS JOIN (SELECT unnest(range(13)) AS j) j WHERE m.d < x.doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t, count(*) AS n FROM u ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op10_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op8_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS own FROM w),
c AS (SELECT own, min(doc_id) AS class, len(own) AS n FROM s WHERE len(own) > 0 GROUP BY own),
x AS (SELECT class, n, unnest(own) AS k FROM c),
l AS (SELECT a.class AS a, b.class AS b FROM x a JOIN x b ON a.k = b.k AND a.class <> b.class GROUP BY a.class, b.class HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT class, class FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
t AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, coalesce(c.class, s.doc_id) AS class_id, coalesce(t.least, s.doc_id) AS component_id FROM s LEFT JOIN c ON len(s.own) > 0 AND s.own = c.own LEFT JOIN t ON t.a = c.class""",
    "op12_conversation_trie": """WITH s AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, n FROM s),
c AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS b, count(*) AS own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c, p AS d, k, n FROM c JOIN t ON t.conv_id = b AND p <= h UNION ALL SELECT c.c, least(c.h, coalesce(o.own, 0)) + p - c.h, k, n FROM c JOIN t ON t.conv_id = c.c AND p > c.h LEFT JOIN c o ON o.c = c.b),
l AS (SELECT c.c, coalesce(list(k ORDER BY d) FILTER (d IS NOT NULL), []) AS ks, coalesce(list(n ORDER BY d) FILTER (d IS NOT NULL), []) AS ns FROM c LEFT JOIN r ON r.c = c.c GROUP BY c.c),
x AS (SELECT *, array_to_string(ks[1:d], ',') AS node FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM l)),
nodes AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(ns[d]), 0) AS n, any_value(array_to_string(ks[1:d - 1], ',')) AS above, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len(ks)), '')) AS ends_sha256 FROM x GROUP BY d, node),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, node)),
tops AS (SELECT a AS d, array_to_string(ks[1:a], ',') AS node, childless, saved FROM (SELECT ks, n_children = 0 AS childless, (n_convs - 1) * n AS saved, unnest(range(d + 1)) AS a FROM own JOIN l ON l.c = own.conv_id)),
under AS (SELECT d, node, count(*) FILTER (childless) AS n_leaves, sum(saved) AS saved_tokens FROM tops GROUP BY d, node)
SELECT own.conv_id, own.d AS depth, p.conv_id AS parent_conv_id, own.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, own.ends_sha256 FROM own JOIN under USING (d, node) LEFT JOIN nodes p ON p.d = own.d - 1 AND p.node = own.above""",
    "op13_benchmark_decontamination": r"""WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
x AS (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d JOIN sizes ON len(ws) >= n)),
h AS (SELECT r, item, s, x.n FROM x JOIN w USING (n, k)),
places AS (SELECT r, count(*) AS hit FROM (SELECT DISTINCT r, s + unnest(range(n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, hit IS NOT NULL AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
}
