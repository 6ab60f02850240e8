"""DuckDB SQL of the queries whose whole result it can express."""

from palimpsest.llm.chat import MARK_PATTERN

#: Fixed by the contract of words: other characters than space and U+0009 to U+000D.
_WORDS = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM t WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), reach AS (
  WITH RECURSIVE r(node, root) AS (
    SELECT doc_id, doc_id FROM t
    UNION
    SELECT b, root FROM r JOIN links ON a = node WHERE root < b
  ) SELECT node, min(root) AS component_id FROM r GROUP BY node
)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM t LEFT JOIN sizes ON sizes.doc_id = t.doc_id LEFT JOIN reach ON node = t.doc_id
"""

OP7 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r
), base AS (
  SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORDS}')] AS lines,
    len([x FOR x IN w IF regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1]) AS n_upper
  FROM t
), features AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, n_upper, coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_upper > 30 * n_words) AS kept
FROM judged
"""

#: The lengths 15, 13, 7 and 19 are those of the marks around a turn; a turn is escaped if it would be read back different.
OP5 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)
), judged AS (
  SELECT *, regexp_matches(role || chr(10) || text, '{MARK_PATTERN}|\\\\|\\l|\\b') AS hard FROM t
), sized AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length(CASE WHEN hard THEN replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b') ELSE role END) END
    + length(CASE WHEN hard THEN replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b') ELSE text END) AS chars
  FROM judged
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
