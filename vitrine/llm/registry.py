"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import sql
from vitrine.llm.conversation_trie import op11_conversation_trie
from vitrine.llm.decontaminate import op6_decontaminate
from vitrine.llm.inner_product import op7_inner_product
from vitrine.llm.language_ppm import op5_language_ppm
from vitrine.llm.packing import op9_best_fit_packing
from vitrine.llm.quality_net import op1_quality_net
from vitrine.llm.simhash import op2_simhash
from vitrine.llm.substring_dedup import op4_substring_dedup
from vitrine.llm.suffix_dedup import op8_suffix_dedup
from vitrine.llm.template_text import op13_template_text
from vitrine.llm.token_codes import op10_token_codes
from vitrine.llm.vector_codes import op12_vector_codes
from vitrine.llm.warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_net": op1_quality_net,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_ppm": op5_language_ppm,
    "op6_decontaminate": op6_decontaminate,
    "op7_inner_product": op7_inner_product,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_codes": op10_token_codes,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_vector_codes": op12_vector_codes,
    "op13_template_text": op13_template_text,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body,
                          CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
        firsts AS (SELECT body, max(page_id) AS resp FROM p WHERE n >= 1000 GROUP BY body)
        SELECT p.page_id, p.n AS payload_bytes, sha1(p.body) AS payload_digest,
               CASE WHEN f.resp IS NULL OR f.resp = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.resp <> p.page_id THEN f.resp END AS refers_to
        FROM p LEFT JOIN firsts f ON p.n >= 1000 AND f.body = p.body""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
        starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d),
        wins AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM starts),
        firsts AS (SELECT g, min(doc_id) AS least FROM wins GROUP BY g HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT w.doc_id, w.p FROM wins w JOIN firsts f ON w.g = f.g WHERE w.doc_id > f.least),
        gone AS (SELECT DISTINCT doc_id, p + k AS pos FROM hits, range(13) AS t(k)),
        kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS body, count(*) AS n
                 FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op7_inner_product": """
        WITH e AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (
                  PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
        starts AS (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 49)) AS p FROM d),
        wins AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS g FROM starts),
        firsts AS (SELECT g, min(doc_id) AS least FROM wins GROUP BY g HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT w.doc_id, w.p FROM wins w JOIN firsts f ON w.g = f.g WHERE w.doc_id > f.least),
        marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50
                                          THEN 0 ELSE 1 END AS fresh FROM hits),
        numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
        spans AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM numbered GROUP BY doc_id, run),
        ordered AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS after FROM spans),
        kept AS (SELECT o.doc_id, string_agg(substr(d.hx, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS body,
                        max(e) AS last, count(*) AS n, sum(e - s) AS gone
                 FROM ordered o JOIN d ON o.doc_id = d.doc_id GROUP BY o.doc_id)
        SELECT d.doc_id, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(body || substr(hx, 2 * last + 1), hx))) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op11_conversation_trie": sql.TRIE,
    "op12_vector_codes": sql.CODES,
    "op13_template_text": sql.TEXT,
}
