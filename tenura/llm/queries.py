"""The registered queries of the subpackage, and SQL statements for those that SQL can express."""

from __future__ import annotations

from tenura.llm import seekable_fim, vector_codes
from tenura.llm.bloom_lm import op12_bloom_lm
from tenura.llm.bucket_pointers import op1_bucket_pointers
from tenura.llm.decision_list import op4_decision_list
from tenura.llm.edit_matching import op7_edit_matching
from tenura.llm.paragraphs import op6_paragraphs
from tenura.llm.pivot_simhash import op9_pivot_simhash
from tenura.llm.seekable_fim import op11_seekable_fim
from tenura.llm.simple8b import op2_simple8b
from tenura.llm.subword_language import op5_subword_language
from tenura.llm.two_fit import op8_two_fit
from tenura.llm.vector_codes import op13_vector_codes
from tenura.llm.virtual_slots import op10_virtual_slots
from tenura.llm.weak_toxicity import op3_weak_toxicity

QUERIES = {
    "op1_bucket_pointers": op1_bucket_pointers,
    "op5_subword_language": op5_subword_language,
    "op6_paragraphs": op6_paragraphs,
    "op7_edit_matching": op7_edit_matching,
    "op8_two_fit": op8_two_fit,
    "op2_simple8b": op2_simple8b,
    "op3_weak_toxicity": op3_weak_toxicity,
    "op4_decision_list": op4_decision_list,
    "op9_pivot_simhash": op9_pivot_simhash,
    "op10_virtual_slots": op10_virtual_slots,
    "op11_seekable_fim": op11_seekable_fim,
    "op12_bloom_lm": op12_bloom_lm,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op11_seekable_fim": seekable_fim.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
    # every 50-byte string of every text, as hexadecimal digits
    "op1_bucket_pointers": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n
           FROM documents),
s AS (SELECT doc_id, unnest(range(0, greatest(n - 49, 0))) AS i,
             unnest(list_transform(range(0, greatest(n - 49, 0)), lambda k: substr(h, 2 * k + 1, 100))) AS s FROM d),
first AS (SELECT s, min(doc_id) AS first_id FROM s GROUP BY s),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p
        FROM s JOIN first USING (s) WHERE first_id < doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
         FROM hit),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept, max(b) AS upto,
               CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
        FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
}
