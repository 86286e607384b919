"""The queries of this folder and the SQL of those that SQL can state."""

from __future__ import annotations

from .decontaminate import op2_decontamination
from .html_extract import op7_html_extraction
from .importance import op13_importance_resampling
from .language_id import op8_language_id
from .licenses import op10_license_scan
from .packing import op9_best_fit_packing
from .personal import op12_personal_data
from .quality import op3_quality_rules
from .simhash import op5_simhash
from .tandem import op11_periodic_runs
from .token_counts import op4_token_counts
from .token_store import op6_token_output
from .url_filter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_decontamination,
        op3_quality_rules,
        op4_token_counts,
        op5_simhash,
        op6_token_output,
        op7_html_extraction,
        op8_language_id,
        op9_best_fit_packing,
        op10_license_scan,
        op11_periodic_runs,
        op12_personal_data,
        op13_importance_resampling,
    )
}

#: Benchmark decontamination is plain SQL over distinct shingles.
ORACLE = {
    "op2_decontamination": """
        WITH shingles AS (
            SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM benchmark
        ), parts AS (
            SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM shingles WHERE len(w) >= 5)
        ), sizes AS (SELECT id, count(*) AS n FROM parts WHERE side = 1 GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, count(*)::DOUBLE / any_value(n) AS containment
        FROM parts d JOIN parts b ON b.side = 1 AND d.side = 0 AND d.s = b.s JOIN sizes ON sizes.id = b.id
        GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
    """,
    # the checksum table comes from the polynomial; each distinct string is reduced over it once
    "op13_importance_resampling": """
        WITH RECURSIVE step AS (
            SELECT range AS byte, range::UBIGINT AS c, 0 AS k FROM range(256)
            UNION ALL
            SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY byte) AS by_byte FROM step WHERE k = 8),
        words AS (
            SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
        ), counts AS (
            SELECT side, id, f, count(*) AS n FROM (SELECT side, id, unnest(w) AS f FROM words) GROUP BY ALL
        ), strings AS (
            SELECT f, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counts GROUP BY f
        ), hashed AS (
            SELECT f, s, t, (xor(list_reduce(list_transform(range(len(hex(f)) // 2), lambda i: ('0x' || hex(f)[2 * i + 1:2 * i + 2])::UBIGINT), lambda c, b: xor(c >> 8, by_byte[(xor(c, b) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
            FROM strings, crc
        ), gains AS (
            SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (sum(sum(s)) OVER () + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * (sum(sum(t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM hashed GROUP BY bucket
        ), weights AS (
            SELECT c.id, sum(c.n * g.gain)::BIGINT AS weight FROM counts c JOIN hashed h USING (f) JOIN gains g USING (bucket) WHERE c.side = 0 GROUP BY c.id
        ), scored AS (
            SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.id)[1:8])::UBIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
            FROM words w LEFT JOIN weights USING (id) WHERE w.side = 0
        ), placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
        )
        SELECT s.*, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
    """,
}
