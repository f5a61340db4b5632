"""DuckDB SQL of the queries that SQL can express."""

from shelfmark.llm.chat import ESCAPE_PATTERN, MarkedTemplate
from shelfmark.llm.queries import CONTROL_TEXT

_T = MarkedTemplate()
_MARKS = len(_T.turn) + len(_T.text) + len(_T.end)


def _escaped(column: str) -> str:
    return f"length(regexp_replace({column}, '{ESCAPE_PATTERN}', '\\1\\2\\\\\\3', 'g'))"


OP2 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
         ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum({_MARKS} + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS rewritten_prefixes
FROM turns GROUP BY conv_id
"""

OP13 = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum([a.c[i] * b.c[i] FOR i IN range(1, len(a.c) + 1)]) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""

ORACLE = {"op2_chat_format": OP2, "op13_hard_negatives": OP13}
