"""DuckDB SQL for the rows of the queries that SQL can express."""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def jaccard_sql(n: int, p: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n}
    THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= {p} * (ca.n + cb.n - i)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
low AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, low.component_id
FROM documents d LEFT JOIN c USING (doc_id) JOIN low ON low.a = d.doc_id
"""


_HEX = "sha1(coalesce(html, ''))"
_B32 = " || ".join(
    "list_aggregate(list_transform(range(0, 8), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"CAST(((('0x' || substr({_HEX}, {1 + 10 * g}, 10))::BIGINT >> (35 - 5 * k)) & 31) AS INTEGER) + 1, 1)), 'string_agg', '')"
    for g in range(4)
)

WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_B32} AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""

CHAT_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER () AS row FROM conversations),
l AS (
  SELECT conv_id, turn, row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM m WHERE text IS NOT NULL),
q AS (
  SELECT conv_id, turn, row, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
    substr(line, length(regexp_extract(line, '^[ \t]*(>[ \t]*)+')) + 1) AS content
  FROM l),
k AS (
  SELECT *, trim(lower(regexp_replace(content, '[\x09-\x0D ]+', ' ', 'g')), ' ') AS norm,
    coalesce(lead(level) OVER (PARTITION BY row ORDER BY i), 0) AS next_level
  FROM q),
g AS (SELECT *, sum(CASE WHEN norm = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS blanks, lag(level) OVER (PARTITION BY row ORDER BY i) AS before, lag(norm) OVER (PARTITION BY row ORDER BY i) AS before_norm FROM k),
h AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> level OR before_norm = '' THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS run FROM g),
o AS (SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) AS passage FROM h WHERE norm <> '' GROUP BY conv_id, turn, row, run, level),
t AS (SELECT conv_id, turn, level, passage FROM o UNION SELECT conv_id, turn, level, norm FROM h WHERE norm <> ''),
s AS (
  SELECT a.conv_id, a.turn, a.level, a.passage, coalesce(max(b.turn) FILTER (b.level = a.level - 1), max(b.turn) FILTER (b.level = 0)) AS source
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.passage = b.passage AND a.level >= 1 AND b.level IN (a.level - 1, 0) AND b.turn < a.turn GROUP BY 1, 2, 3, 4),
b AS (SELECT conv_id, turn, source, sum(length(passage)) AS chars FROM s GROUP BY 1, 2, 3),
e AS (SELECT conv_id, turn, source AS parent_turn FROM b QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, source DESC) = 1),
r AS (
  SELECT conv_id, turn, parent_turn, parent_turn AS root_turn, 1 AS depth FROM e
  UNION ALL SELECT r.conv_id, r.turn, r.parent_turn, e.parent_turn, r.depth + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.root_turn = e.turn),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1),
c AS (
  SELECT row, string_agg(content, chr(10) ORDER BY i) AS text FROM k
  WHERE level = 0 AND NOT (next_level > 0 AND regexp_matches(content, '^(On .* wrote:|Am .* schrieb .*:|Le .* a écrit ?:|El .* escribió:)[ \t]*$'))
  GROUP BY row)
SELECT m.conv_id, m.turn, m.role,
  CASE WHEN m.text IS NOT NULL THEN regexp_replace(coalesce(c.text, ''), '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g') END AS text,
  z.parent_turn, coalesce(z.root_turn, m.turn) AS root_turn, CAST(coalesce(z.depth, 0) AS INTEGER) AS depth
FROM m LEFT JOIN c USING (row) LEFT JOIN z ON z.conv_id = m.conv_id AND z.turn = m.turn
"""

ORACLES = {"op4_chat_formatting": CHAT_SQL, "op5_warc": WARC_SQL, "op7_jaccard_join": jaccard_sql(3, 90)}
