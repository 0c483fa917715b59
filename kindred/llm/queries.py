"""The registered queries opN_<name> and their oracles."""

from kindred.llm import bpe, html, licenses, packing, quality, simhash, suffixes, topk, toxicity, warc

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP5 = rf"""
WITH a AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM a),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(0, 8) AS x(k) GROUP BY doc_id),
s AS (SELECT a.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
 FROM a JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1.0 END AS k FROM p),
o AS (SELECT source, (f + m * k) / (n + k) <= 0.5 AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM b JOIN o USING (source)
"""


def queries():
    return {
        "op1_toxicity": toxicity.op1, "op2_simhash": simhash.op2, "op3_bpe": bpe.op3, "op4_packing": packing.op4, "op5_quality": quality.op5,
        "op6_warc": warc.op6, "op7_suffixes": suffixes.op7, "op8_licenses": licenses.op8, "op9_topk": topk.op9, "op10_html": html.op10,
    }


def oracle_sql():
    return {"op5_quality": OP5, "op9_topk": topk.ORACLE}
