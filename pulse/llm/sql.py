"""SQL counterparts, for DuckDB, of the queries that SQL can express."""

#: Words of a lower-cased text: runs of all but ASCII gaps.
WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def crc32(text: str) -> str:
    """crc32 of a text expression's UTF-8 bytes, bit by bit, with the polynomial of zlib."""
    code = f"hex(encode({text}))"
    return f"""xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length({code}) // 2), lambda i: ('0x' || substr({code}, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))
    ), 4294967295::BIGINT)"""


RESAMPLING = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
dw AS (SELECT unnest(words) AS w FROM d),
bw AS (SELECT unnest({WORDS}) AS w FROM benchmark),
hashed AS (SELECT w, {crc32('w')} % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw))),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(words) AS w FROM d) JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= able * 10 // 100 THEN place END AS rank FROM scored s LEFT JOIN ranked USING (doc_id)
"""

PREFIX_TRIE = f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place,
  [coalesce(role, ''), coalesce(text, '')] AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc32('conv_id::VARCHAR')} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (SELECT c.conv_id, 0 AS kind, place, said FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= h
  UNION ALL SELECT conv_id, 1, place, said FROM turns JOIN convs USING (conv_id) WHERE place > h),
seqs AS (SELECT conv_id, coalesce(list(said ORDER BY kind, place) FILTER (WHERE said IS NOT NULL), []) AS seq FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, unnest(list_transform(range(0, len(seq) + 1), lambda n: seq[1:n])) AS prefix, len(seq) AS size FROM seqs),
nodes AS (SELECT prefix, len(prefix) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CASE WHEN size = len(prefix) THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM members GROUP BY prefix),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.prefix, depth, coalesce(n_children, 0) AS n_children,
  CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(n.prefix[depth][2])) ELSE 0 END AS cost FROM nodes n LEFT JOIN kids USING (prefix)),
below AS (SELECT a.prefix[1:e] AS prefix, sum(cost) AS saved, sum((n_children = 0)::BIGINT) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM own) a GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, o.n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN own o USING (prefix) JOIN below USING (prefix) LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""
