"""DuckDB SQL for the queries that SQL can express."""

# Measurements of every row of a table ``{docs}`` with doc_id and text. A row is
# known by its place, so repeated ids stay apart.
RULE_MEASURES = r"""
rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {docs}),
split_ AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM rows_),
places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split_),
windows_ AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows_, range(3) AS ks(k) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT doc_id, s.r, s.t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals
  FROM split_ s LEFT JOIN covered c ON c.r = s.r),
judged AS (
  SELECT *, (n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2
          + (100 * n_symbols > 20 * n_words)::INT * 4 + (100 * n_dup_lines > 60 * n_lines)::INT * 8
          + (100 * n_capitals > 40 * word_chars)::INT * 16
          + (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT * 32 AS fail_bits
  FROM measured)
"""

OP8 = "WITH " + RULE_MEASURES.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals,
       fail_bits, 'v1' AS policy, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM judged
"""

# Words that windows of 50 words cover whose words also start in a smaller id.
REPEAT_CUT = r"""
cut_rows AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
cut_starts AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut_rows),
cut_hashed AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM cut_starts),
cut_least AS (SELECT h, min(doc_id) AS least FROM cut_hashed GROUP BY h),
cut_hits AS (SELECT r, i FROM cut_hashed JOIN cut_least USING (h) WHERE doc_id > least),
cut_gone AS (SELECT r, list(DISTINCT i + k) AS gone FROM cut_hits, range(50) AS ks(k) GROUP BY r),
cut_kept AS (
  SELECT c.r, doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
         array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ') AS kept
  FROM cut_rows c LEFT JOIN cut_gone g ON g.r = c.r)
"""

OP10 = "WITH " + REPEAT_CUT.replace("{docs}", "documents") + """
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM cut_kept
"""

OP11 = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT * FROM q WHERE vec_id % 50 = 0),
s AS (SELECT DISTINCT a.vec_id AS anchor, a.label AS own, a.v AS av, q.vec_id, q.label, CAST(list_dot_product(a.v, q.v) AS BIGINT) AS score
      FROM a, q),
p AS (SELECT anchor, own, av, vec_id AS positive, score AS positive_score FROM s
      WHERE label = own AND vec_id <> anchor
      QUALIFY row_number() OVER (PARTITION BY anchor, own, av ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT s.anchor, p.positive, p.positive_score, s.vec_id AS negative, s.score,
             row_number() OVER (PARTITION BY s.anchor, s.own, s.av, p.positive, p.positive_score ORDER BY s.score DESC, s.vec_id) AS rank
      FROM s JOIN p ON s.anchor = p.anchor AND s.own = p.own AND s.av = p.av
      WHERE s.label <> s.own AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id,
       positive_score, score AS negative_score
FROM n WHERE rank <= 3
"""


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '\\', '\\s'), '###', '\\h'), '</turn>', '\\t')"


OP13 = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) r(i)),
o AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM said
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
d AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS said,
             coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length({_escaped('text')}) + 8
                 + CASE WHEN before IS NULL OR before <> role THEN length(replace({_escaped('role')}, ':', '\\c')) + 6 ELSE 0 END) AS chars
      FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       chars::BIGINT AS formatted_chars
FROM d
"""

SQL: dict[str, str] = {
    "op8_quality_rules": OP8,
    "op10_substring_dedup": OP10,
    "op11_hard_negatives": OP11,
    "op13_chat_formatting": OP13,
}
