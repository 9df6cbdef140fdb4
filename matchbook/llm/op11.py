"""Query op11: the prefix trie of all rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.trie import prefix_trie

SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
    SELECT i::BIGINT, 0, i::BIGINT FROM range(256) r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth FROM conversations),
digits AS (SELECT c.conv_id, i, ascii(substr(c.conv_id::VARCHAR, i::INT, 1))::BIGINT AS b FROM (SELECT DISTINCT conv_id FROM rows) c, range(1, 25) r(i) WHERE i <= length(c.conv_id::VARCHAR)),
sums AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list(b ORDER BY i)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS s FROM digits, crc GROUP BY conv_id, t),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(s, 4294967295::BIGINT) % 6 AS h FROM sums),
heads AS (SELECT ids.conv_id, r.nth AS pos, r.role, r.text FROM ids JOIN rows r ON r.conv_id = ids.base AND r.nth <= ids.h),
given AS (SELECT ids.conv_id, ids.h, count(heads.pos) AS g FROM ids LEFT JOIN heads USING (conv_id) GROUP BY 1, 2),
turns AS (SELECT * FROM heads UNION ALL SELECT r.conv_id, r.nth - g.h + g.g, r.role, r.text FROM rows r JOIN given g USING (conv_id) WHERE r.nth > g.h),
convs AS (SELECT ids.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS path,
                 coalesce(list(length(text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS chars FROM ids LEFT JOIN turns USING (conv_id) GROUP BY 1),
members AS (SELECT conv_id, d AS depth, array_to_string(path[1:d], '/') AS node, array_to_string(path[1:d-1], '/') AS up,
                   CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(path) AS ends FROM convs, unnest(range(0, len(path) + 1)) u(d)),
nodes AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, node)),
sub AS (SELECT m.depth, m.node, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars) AS saved_tokens
        FROM own o JOIN members m ON m.conv_id = o.conv_id AND m.depth <= o.depth GROUP BY 1, 2)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN sub s USING (depth, node) LEFT JOIN own p ON o.depth > 0 AND p.depth = o.depth - 1 AND p.node = o.up
"""


@query("op11_conversation_prefix_trie", SQL)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with members, subtree sums and ends."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
