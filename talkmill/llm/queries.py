"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from talkmill.llm import alignment, bpe, collocations, decontam, jaccard, line_windows, order_minhash, packing, quality, secret_scan, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.toxicity_query,
    "op2_decontamination": decontam.decontam_query,
    "op3_secret_scan": secret_scan.secrets_query,
    "op4_quality": quality.quality_query,
    "op5_byte_bpe": bpe.bpe_query,
    "op6_url_filter": url_filter.url_query,
    "op7_line_dedup": line_windows.line_dedup_query,
    "op8_suffix_dedup": suffix_dedup.suffix_query,
    "op9_jaccard_join": jaccard.jaccard_query,
    "op10_order_minhash": order_minhash.fingerprint_query,
    "op11_alignment": alignment.alignment_query,
    "op12_collocations": collocations.collocations_query,
    "op13_packing": packing.packing_query,
}

#: All pairs that share a shingle, and all that links reach: for tables of a few thousand documents.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)
), size AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), neighbour AS MATERIALIZED (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reached AS (
  SELECT a AS doc_id, b AS other FROM neighbour
  UNION
  SELECT r.doc_id, n.b FROM reached r JOIN neighbour n ON n.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS other FROM reached GROUP BY 1) r USING (doc_id)
"""
ORACLE = {
    "op3_secret_scan": secret_scan.secrets_sql(),
    "op7_line_dedup": line_windows.LINE_DEDUP_SQL,
    "op8_suffix_dedup": suffix_dedup.SUFFIX_SQL,
    "op9_jaccard_join": JACCARD_SQL,
    "op12_collocations": collocations.COLLOCATIONS_SQL,
}
