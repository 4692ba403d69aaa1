"""SQL for DuckDB with the results of the registered queries, where SQL can express them.

Stated on its own: nothing of the operators is imported.
"""

OP1 = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
linked AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS to_id FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN linked l ON r.to_id = l.a
), least AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

OP7 = r"""
WITH cut AS (
    SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), windows AS (
    SELECT row, i, count(*) OVER (PARTITION BY row, s) AS times FROM (
        SELECT row, unnest(range(1, len(w) - 6)) AS i,
            unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s
        FROM cut WHERE len(w) >= 8
    )
), repeats AS (
    SELECT row, count(DISTINCT place) AS n FROM (
        SELECT row, unnest(range(i, i + 8)) AS place FROM windows WHERE times > 1
    ) GROUP BY row
), stats AS (
    SELECT row, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM cut LEFT JOIN repeats USING (row)
), scores AS (
    SELECT row, doc_id, lang, unnest([
        {'rule': 1, 'score': n_symbols / greatest(word_chars, 1)},
        {'rule': 2, 'score': n_dup_lines / greatest(n_lines, 1)},
        {'rule': 3, 'score': n_repeat_words / greatest(n_words, 1)},
        {'rule': 4, 'score': word_chars / greatest(n_words, 1)},
        {'rule': 5, 'score': -(word_chars / greatest(n_words, 1))}], recursive := true)
    FROM stats
), cutoffs AS (
    SELECT rule, CAST(cutoff AS DOUBLE) AS cutoff
    FROM (SELECT unnest([1, 2, 3]) AS rule), (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7]) AS cutoff)
    UNION ALL SELECT 4, unnest([6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0])
    UNION ALL SELECT 5, unnest([-4.5, -4.25, -4.0, -3.75, -3.5, -3.0, -2.5, -2.0, -1.5, -1.0])
), good AS (
    SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1
), counts AS (
    SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS x
    FROM scores JOIN good USING (doc_id) JOIN cutoffs USING (rule) GROUP BY ALL
), certified AS (
    SELECT lang, rule, min(cutoff) AS cutoff FROM counts
    WHERE x < n * 0.005 AND list_sum(list_transform(range(0, x + 1), lambda k:
        exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.005) + (n - k) * ln(0.995))
    )) <= 0.05 / (50 * (SELECT count(DISTINCT coalesce(lang, '')) FROM counts))
    GROUP BY ALL
), rejected AS (
    SELECT DISTINCT row FROM scores s JOIN certified c
    ON s.rule = c.rule AND s.lang IS NOT DISTINCT FROM c.lang AND s.score > c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND row NOT IN (SELECT row FROM rejected) AS kept
FROM stats
"""

OP8 = r"""
WITH every AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted AS (
    SELECT *, length(role) + length(text)
        + len(regexp_extract_all(role || text, '\\'))
        + 2 * len(regexp_extract_all(role || chr(10) || text, '<\||</?s>|<</?SYS>>|\[/?INST\]'))
        + 23 AS chars
    FROM every
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""
