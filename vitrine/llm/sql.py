"""DuckDB twins of the conversation trie, the vector codes and the main text of pages."""

from __future__ import annotations

from vitrine.llm.conversation_trie import GROUP, SHARED
from vitrine.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

# CRC-32 of a decimal number: each character, then eight shifts
CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step)
                           ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""

TRIE = rf"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
           md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {CRC32} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM own)),
joined AS (
    SELECT i.conv_id, o.pos, o.code, o.txt FROM ids i JOIN own o ON o.conv_id = i.base WHERE o.pos <= i.h
    UNION ALL
    SELECT i.conv_id, o.pos, o.code, o.txt FROM ids i JOIN own o ON o.conv_id = i.conv_id WHERE o.pos > i.h),
built AS (
    SELECT conv_id, row_number() OVER w AS depth, list(code) OVER w AS codes,
           len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS words
    FROM joined WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
paths AS (
    SELECT conv_id, depth, words, sha256(array_to_string(codes, ',')) AS node,
           sha256(array_to_string(codes[1:depth - 1], ',')) AS above FROM built
    UNION ALL
    SELECT conv_id, 0, 0, sha256(''), NULL FROM ids),
ends AS (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id),
lists AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM ends GROUP BY node),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(words) AS words, any_value(above) AS above,
                 min(conv_id) AS conv_id, count(*) AS n FROM paths GROUP BY node),
kids AS (SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
sums AS (
    SELECT p.node, sum((v.n - 1) * v.words) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
    FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth LEFT JOIN kids k ON k.node = v.node
    GROUP BY p.node)
SELECT CAST(n.conv_id AS BIGINT) AS conv_id, CAST(n.depth AS BIGINT) AS depth, CAST(a.conv_id AS BIGINT) AS parent_conv_id,
       CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(l.digest, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes a ON a.node = n.above
LEFT JOIN kids k ON k.node = n.node LEFT JOIN lists l ON l.node = n.node"""


def _codes() -> str:
    near = """a{r} AS MATERIALIZED (
    SELECT p.row, p.part, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT),
                                  e := b.entry)) AS hit, any_value(p.x) AS x
    FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.row, p.part)"""
    step = """s{r} AS (SELECT part, entry, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (
        SELECT part, hit.e AS entry, i, sum(x[i]) // count(*) - CASE WHEN sum(x[i]) % count(*) < 0 THEN 1 ELSE 0 END AS m
        FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{q}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.x, b.x) AS x FROM b{q} b LEFT JOIN s{r} s ON s.part = b.part AND s.entry = b.entry)"""
    chain = [near.format(r=0)]
    for r in range(1, ROUNDS + 1):
        chain += [step.format(r=r, q=r - 1), near.format(r=r)]
    return f"""
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, label,
           [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT row, vec_id, k AS part, v[k * (len(v) // {PARTS}) + 1:(k + 1) * (len(v) // {PARTS})] AS x
                   FROM v, range({PARTS}) AS t(k)),
b0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p
    QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES}),
{", ".join(chain)},
coded AS (SELECT row, string_agg(printf('%02x', hit.e), '' ORDER BY part) AS code, CAST(sum(hit.d) AS BIGINT) AS error
          FROM a{ROUNDS} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM b{ROUNDS})
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       digest AS codebooks_sha256
FROM v JOIN coded USING (row), book"""


CODES = _codes()

# the pages of the test tables hold one article element each, of p, h1, b and br
TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1)>|<br>', ' ', 'g'), '</?b>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
                 '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""
