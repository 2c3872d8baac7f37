"""Registered queries of the corpus operators, with their SQL twins where SQL can express them."""

from placelens.llm.decontamination import op8_decontamination
from placelens.llm.hard_negatives import op11_hard_negatives
from placelens.llm.language import op13_language
from placelens.llm.lexical_search import op12_lexical_search
from placelens.llm.line_dedup import op10_line_dedup
from placelens.llm.ngram_join import op9_ngram_join
from placelens.llm.pii import op6_pii
from placelens.llm.pieces import op2_sentencepiece
from placelens.llm.quality import op4_quality
from placelens.llm.toxicity import op7_toxicity
from placelens.llm.wavelet import op5_wavelet
from placelens.llm.vectors import op1_vector_dedup
from placelens.llm.warc import op3_warc

QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_wavelet": op5_wavelet,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_language": op13_language,
}

SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        q AS (SELECT page_id, payload, CASE WHEN strlen(payload) >= 1000
                     THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM p)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q""",
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                     CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
             AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
        QUALIFY row_number() OVER w <= 5""",
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        size AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
        tf AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf
               FROM (SELECT row, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY row, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
        s AS (SELECT item_id, row, any_value(doc_id) AS doc_id,
                     CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // length)))) AS BIGINT) AS score
              FROM i JOIN tf USING (term) JOIN w USING (term), size WHERE doc_id IS NOT NULL GROUP BY item_id, row)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
}
