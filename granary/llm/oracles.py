"""What the operators must give, in SQL that DuckDB runs on the same tables; written from their rules."""

from __future__ import annotations

_GAP = r"[\x20\x09-\x0D]+"

_METRICS = {"symbol_rate": (10, False), "word_length": (100, True), "dup_line_rate": (60, False)}

QUALITY = (
    rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(t, '{_GAP}'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs
), word AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), windowed AS (
  SELECT r, i, CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN
         concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS five
  FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
), marked AS (
  SELECT r, i, CASE WHEN five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 THEN 1 ELSE 0 END AS again FROM windowed
), covered AS (
  SELECT r, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM marked
), repeated AS (
  SELECT r, sum(c) AS n FROM covered GROUP BY r
), counted AS (
  SELECT s.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeated p USING (r)
), measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_rate,
         CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length,
         CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_words ELSE 0 END AS dup_line_rate
  FROM counted
), long AS (
  UNPIVOT (SELECT r, lang, source, symbol_rate, word_length, dup_line_rate FROM measured WHERE NOT base_failed)
  ON symbol_rate, word_length, dup_line_rate INTO NAME metric VALUE v
), cut AS (
  SELECT r, lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS v FROM long
)"""
    + "".join(
        f""", q_{level} AS (
  SELECT {keys} metric, count(*) AS docs, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM cut GROUP BY ALL
)"""
        for level, keys in (("own", "lang, source,"), ("lang", "lang,"), ("whole", ""))
    )
    + """, chosen AS (
  SELECT o.lang, o.source, o.metric,
         CASE WHEN o.docs >= 100 THEN o.q1 WHEN l.docs >= 100 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.docs >= 100 THEN o.q3 WHEN l.docs >= 100 THEN l.q3 ELSE a.q3 END AS q3
  FROM q_own o JOIN q_lang l ON o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang JOIN q_whole a ON a.metric = o.metric
), failing AS (
  SELECT m.r FROM measured m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
  WHERE """
    + " OR ".join(
        f"(c.metric = '{name}' AND ({name} > q3 + 3 * greatest(q3 - q1, {least})"
        + (f" OR {name} < q1 - 3 * greatest(q3 - q1, {least})" if low else "")
        + "))"
        for name, (least, low) in _METRICS.items()
    )
    + """
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM failing) AS kept FROM measured"""
)

LINES = r"""
WITH line AS (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), first AS (
  SELECT k, min(doc_id) AS d FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, first.d IS NOT NULL AND doc_id > first.d AS gone FROM keyed LEFT JOIN first USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

PASSAGES = (
    rf"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') AS ws FROM documents
), word AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split
), windowed AS (
  SELECT doc_id, i, CASE WHEN lead(i, 12) OVER o IS NOT NULL THEN concat_ws(' ', w, """
    + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, 13))
    + """) END AS passage, w FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), first AS (
  SELECT passage, min(doc_id) AS d FROM windowed WHERE passage IS NOT NULL GROUP BY passage HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT doc_id, i, w, CASE WHEN first.d < doc_id THEN 1 ELSE 0 END AS shared FROM windowed LEFT JOIN first USING (passage)
), covered AS (
  SELECT doc_id, i, w, max(shared) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM marked
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""
)

SIMILAR = (
    rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_GAP}'), lambda x: x <> '') AS ws FROM documents
), runs AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS own FROM split
), each AS (
  SELECT doc_id, CAST(len(own) AS BIGINT) AS n, unnest(own) AS run FROM runs
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.run = b.run AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM runs
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reached GROUP BY x
)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_shingles, component_id FROM runs JOIN least ON doc_id = x"""
)

NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor, a.label = b.label AS alike, b.vec_id AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor, other, score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor = p.anchor AND NOT n.alike AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) <= 10"""

SQL = {
    "op1_quality_rules": QUALITY, "op7_line_dedup": LINES, "op8_passage_dedup": PASSAGES,
    "op11_ngram_jaccard_join": SIMILAR, "op12_hard_negatives": NEGATIVES,
}
