"""Registered queries of this folder and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from tapewright.llm import (
    chosen_path, divergence_rules, dom_boost, embedding_classifier, factoring, mixing, monoid_bpe, multi_index, packing, ranked_search, suffix_columns, toxicity,
    whitening)

QUERIES = {
    "op1_multi_index": multi_index.query,
    "op2_embedding_classifier": embedding_classifier.quality,
    "op3_suffix_columns": suffix_columns.query,
    "op4_chosen_path": chosen_path.query,
    "op5_dom_boost": dom_boost.query,
    "op6_relative_lz": factoring.query,
    "op7_toxicity_ftrl": toxicity.toxicity,
    "op8_divergence_rules": divergence_rules.query,
    "op9_monoid_bpe": monoid_bpe.query,
    "op10_vector_packing": packing.query,
    "op11_multinomial_mix": mixing.query,
    "op12_spectrum_slicing": whitening.query,
    "op13_term_pipeline": ranked_search.query,
}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs of documents that share a shingle, and components by reachable ids.
NEAR_DUPLICATES = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_transform({WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles FROM cut),
held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS n
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared WHERE 100 * n >= 80 * (nu + nv - n)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.other)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(shingles)
"""

#: Every window of 50 words with the first document that has it.
EARLIER_WINDOWS = f"""
WITH cut AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + 49), ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM cut)),
first AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS place FROM windows JOIN first USING (w) WHERE doc_id > first_id),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM cut),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS text, count(*) AS n
  FROM placed p ANTI JOIN covered c ON c.doc_id = p.doc_id AND c.place = p.place GROUP BY p.doc_id)
SELECT c.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256 FROM cut c LEFT JOIN kept k USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op4_chosen_path": NEAR_DUPLICATES,
    "op6_relative_lz": EARLIER_WINDOWS,
    "op8_divergence_rules": divergence_rules.oracle_sql(),
    "op11_multinomial_mix": mixing.oracle_sql(),
    "op13_term_pipeline": ranked_search.oracle_sql(),
}
