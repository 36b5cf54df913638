"""DuckDB SQL for the rows of the queries that SQL can express."""

from latticework.llm.quality_rules import BOILERPLATE, TERMINAL

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

LINE_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
s AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS n FROM i),
t AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS own FROM s WHERE n > 1),
r AS (SELECT rid, sum(own)::BIGINT AS n_repeat_words FROM t GROUP BY 1),
f AS (SELECT *, list_filter(lines, lambda l:
        (length(l) - length(replace(l, '|', '')) >= 2 AND 5 * (length(l) - length(replace(l, '|', ''))) >= length(l) - length(replace(l, ' ', '')) + 1)
        OR (greatest(len(regexp_extract_all(l, '[#*$%&<>]{{2,}}')), len(regexp_extract_all(l, '[!?]{{2,}}'))) > 0 AND 5 * greatest(len(regexp_extract_all(l, '[#*$%&<>]{{2,}}')), len(regexp_extract_all(l, '[!?]{{2,}}'))) >= length(l) - length(replace(l, ' ', '')) + 1)
        OR NOT regexp_matches(l, '\p{{L}}') OR {" OR ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)}
        OR (length(l) - length(replace(l, ' ', '')) + 1 < 4 AND NOT contains('{TERMINAL.replace("'", "''")}', right(rtrim(l, ' '), 1)))) AS failed FROM w),
c AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(failed)::BIGINT AS n_lines_failed,
    coalesce(list_sum(list_transform(failed, lambda l: length(l))), 0)::BIGINT AS chars_lost, coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0)::BIGINT AS chars FROM f LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * chars_lost <= 40 * chars AS kept, n_lines, n_lines_failed, chars_lost FROM b"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) - count(*) AS together, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * common >= 85 * together),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(r.b) FROM r WHERE r.a = s.doc_id), doc_id)) AS component_id FROM s"""
