"""DuckDB SQL for those queries of the subpackage that SQL can express."""

from __future__ import annotations

from marginalia.llm import licenses

# A-Z only, as the contracts say.
FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 1 + least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
    QUALIFY rank <= 20
"""

JACCARD = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
    ), grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    one AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
    links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) JOIN sets USING (doc_id)
"""

DECONTAMINATE = rf"""
    WITH words AS (SELECT doc_id, regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    asked AS (SELECT item_id, regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS k FROM asked WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT n FROM windows),
    places AS (
        SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k FROM words, sizes
    ), hits AS (SELECT DISTINCT doc_id, item_id, i, n FROM places JOIN windows USING (n, k)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

HARD_NEGATIVES = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(range(1, 1 + least(len(a.w), len(c.w))), lambda i: a.w[i] * c.w[i]))::BIGINT AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
    ), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM s JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
"""

LEXICAL = rf"""
    WITH words AS (SELECT doc_id, regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({FOLD}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
    whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM words WHERE len(w) > 0),
    postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, whole GROUP BY term, n_docs),
    impacts AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))) AS impact FROM postings JOIN weights USING (term), whole),
    scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

SQL: dict[str, str] = {"op6_exact_top_k": TOP_K, "op7_ngram_jaccard_join": JACCARD, "op9_license_scan": licenses.sql(), "op10_benchmark_decontamination": DECONTAMINATE, "op11_hard_negatives": HARD_NEGATIVES, "op13_lexical_search": LEXICAL}
