"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_COMPONENTS = "r AS (SELECT {id} AS a, {id} AS b FROM {rows} UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS {id}, min(b) AS component_id FROM r GROUP BY a)"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0) x),
        z AS (SELECT doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT m FROM i) q) y),
        h AS (SELECT DISTINCT z.doc_id, z.k, z.m, i.item_id FROM z JOIN i ON z.s = i.s AND z.m = i.m),
        n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS spot FROM h) p GROUP BY doc_id),
        t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op4_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_COMPONENTS.format(id='vec_id', rows='v')}
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c""",
    "op10_minhash_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0) x),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))), {_COMPONENTS.format(id='doc_id', rows='d')}
        SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
}
