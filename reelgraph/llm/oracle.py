"""Comparison SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"""
words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_quality_rules": "WITH" + _WORDS.format(text="text") + r""",
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, (VALUES (0), (1), (2)) AS step(k) WHERE n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM words
), measured AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM measured
""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
""",
    "op5_substring_dedup": "WITH" + _WORDS.format(text="text") + """,
windows AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + 12], ' ')) AS low
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM windows, range(13) AS step(k) WHERE low < doc_id
), held AS (
  SELECT doc_id, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
), cut AS (
  SELECT h.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY h.i) FILTER (g.i IS NULL) AS kept
  FROM held h LEFT JOIN gone g ON g.doc_id = h.doc_id AND g.i = h.i GROUP BY h.doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN cut USING (doc_id)
""",
    "op10_ngram_jaccard_join": "WITH RECURSIVE" + _WORDS.format(
        text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ) + """,
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
), grams AS (
  SELECT doc_id, len(s) AS size, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 90 * (any_value(a.size) + any_value(b.size) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
    "op11_benchmark_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL
), pieces AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), places AS (
  SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM pieces) WHERE len(w) >= k)
), hits AS (
  SELECT r, s, k, item_id FROM places JOIN pieces USING (k, phrase)
), covered AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS place FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op12_ranked_lexical_search": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL
), total AS (
  SELECT count(*) AS n_docs, sum(len(w)) AS n_all FROM d WHERE len(w) > 0
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
), asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN d USING (r), total GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored JOIN d USING (r) WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER best <= 20
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE crc_step AS (
  SELECT i AS byte, 0 AS bit, CAST(i AS UBIGINT) AS c FROM range(256) t(i)
  UNION ALL
  SELECT byte, bit + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END FROM crc_step WHERE bit < 8
), crc_table AS (
  SELECT list(c ORDER BY byte) AS t FROM crc_step WHERE bit = 8
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), coded AS (
  SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
), marked AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(0, length(h) // 2), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS UBIGINT)),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS mark
  FROM coded, crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN mark % 199 = 0 THEN substr(run, 1, CAST(mark % length(run) AS BIGINT)) || substr(run, CAST(mark % length(run) AS BIGINT) + 2)
      ELSE run END AS word FROM marked)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, n, k, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS gap
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM words)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word AND (a.k = b.k OR a.k = 0 OR b.k = 0)
), tops AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word
), forms AS (
  SELECT word, min(other) AS form, any_value(top_n) AS form_n
  FROM tops JOIN near USING (word) WHERE other_n = top_n AND top_n >= 5 * tops.n GROUP BY word
), chain AS (
  SELECT word AS start, word AS here FROM words
  UNION ALL SELECT start, form FROM chain JOIN forms ON forms.word = chain.here
)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words JOIN (SELECT start AS word, here AS root FROM chain WHERE here NOT IN (SELECT word FROM forms)) USING (word)
LEFT JOIN (SELECT word, n_near FROM tops) USING (word) LEFT JOIN forms USING (word)
""",
}
