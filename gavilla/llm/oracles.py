"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('{BASE32}', 1 + ((('0x' || substr(hex, ((5 * i) // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM g
"""

QUOTE = "^ {0,3}>[> ]*"
ATTRIBUTION = "^[^>].*(?:wrote|writes|said|says|schrieb|a écrit|escribió) ?:\\s*$"

CHAT = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM t),
n AS (
  SELECT DISTINCT conv_id, turn, length(regexp_replace(regexp_extract(line, '{QUOTE}'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '{QUOTE}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm
  FROM l
),
q AS (SELECT * FROM n WHERE norm <> '' AND level > 0),
said AS (SELECT conv_id, norm, min(turn) AS first FROM n WHERE norm <> '' AND level = 0 GROUP BY ALL),
votes AS (
  SELECT q.conv_id, q.turn, q.level, said.first, count(*) AS votes FROM q JOIN said USING (conv_id, norm)
  WHERE said.first < q.turn GROUP BY ALL
),
best AS (
  SELECT conv_id, turn, sum(votes)::BIGINT AS n_linked,
    first(first ORDER BY level, votes DESC, first DESC) AS quoted_turn
  FROM votes GROUP BY ALL
),
counts AS (SELECT conv_id, turn, count(*) AS n_quotes, max(level) AS quote_levels FROM q GROUP BY ALL),
nodes AS (SELECT DISTINCT conv_id, turn FROM t),
replies AS (
  SELECT a.conv_id, a.turn, coalesce(best.quoted_turn, b.turn) AS reply_to, n_quotes, quote_levels, n_linked
  FROM nodes a LEFT JOIN nodes b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1
  LEFT JOIN best ON a.conv_id = best.conv_id AND a.turn = best.turn
  LEFT JOIN counts ON a.conv_id = counts.conv_id AND a.turn = counts.turn
),
walk AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM replies WHERE reply_to IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, w.thread, w.depth + 1 FROM replies r JOIN walk w ON r.conv_id = w.conv_id AND r.reply_to = w.turn
),
own AS (
  SELECT conv_id, turn, role, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i:
    NOT regexp_matches(x, '{QUOTE}')
    AND NOT (regexp_matches(x, '{ATTRIBUTION}') AND coalesce(regexp_matches(string_split(text, chr(10))[i + 1], '{QUOTE}'), false))),
    chr(10)), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS text
  FROM t
)
SELECT o.conv_id, o.turn, o.role, o.text, r.reply_to, w.thread, w.depth, coalesce(r.n_quotes, 0) AS n_quotes,
  coalesce(r.quote_levels, 0) AS quote_levels, coalesce(r.n_linked, 0) AS n_linked,
  '<|' || coalesce(o.role, 'user') || '|>' || chr(10) || o.text || chr(10) || '<|end|>' AS message
FROM own o LEFT JOIN replies r ON o.conv_id = r.conv_id AND o.turn = r.turn
LEFT JOIN walk w ON o.conv_id = w.conv_id AND o.turn = w.turn
"""

UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|feet|yd|mi|mile|miles|mg|g|kg|t|lb|lbs|oz|ml|cl|dl|l|s|sec|min|h|hr|hrs|hour|hours|"
    "day|days|week|weeks|month|months|year|years|km/h|mph|m/s|usd|eur|gbp|dollars|euros|percent|degrees|kb|mb|gb|tb|hz|khz|"
    "mhz|ghz|w|kw|mw|v|kv|a|ma|j|kj|cal|kcal|pa|kpa|c|f|k"
)
SPLIT = r"[^\p{L}\p{N}\p{M}\x01\x03]+"


def _marked(table: str, key: str) -> str:
    """Steps a, b, c, ... of the marked text of ``table``; each column is written once and read by the next."""
    clean = r"regexp_replace(translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), '   '), '[\x09-\x0D ]+', ' ', 'g')"
    decimal = r"regexp_replace({}, '([0-9])[.,]([0-9])', '\1' || chr(3) || '\2', 'g')"
    number = rf"'([0-9][0-9\x03]*)(?: ?((?i){UNITS})([^\p{{L}}\p{{N}}\x03]|$))?'"
    name = r"""regexp_replace({}, '([\p{{L}}\p{{N}},;)"''] )(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || 'p\2', 'g')"""
    return f"""
    SELECT {key}, string_split_regex(low, '{SPLIT}') AS raw,
      string_split_regex(regexp_replace(low, '\\x01([nup])[\\p{{L}}\\p{{N}}\\p{{M}}\\x03]*', chr(1) || '\\1', 'g'), '{SPLIT}') AS names
    FROM (SELECT {key}, lower({name.format(name.format("t"))}) AS low FROM (
      SELECT {key}, CASE WHEN regexp_matches(t, '[0-9]') THEN replace(regexp_replace({decimal.format(decimal.format("t"))}, {number},
        ' ' || chr(1) || 'n\\1 ' || chr(1) || 'u\\2 \\3', 'g'), chr(1) || 'u ', ' ') ELSE t END AS t
      FROM (SELECT {key}, {clean} AS t FROM {table} WHERE {key} IS NOT NULL)))"""


LEAKS = f"""
WITH d AS ({_marked("documents", "doc_id")}),
b0 AS ({_marked("benchmark", "item_id")}),
b AS (
  SELECT *, least(8, len(names)) AS size FROM (
    SELECT DISTINCT item_id, list_filter(raw, lambda x: x <> '') AS raw, list_filter(names, lambda x: x <> '') AS names FROM b0)
  WHERE len(names) >= 4
),
bw AS (
  SELECT item_id, size, spot, list_slice(names, spot, spot + size - 1) AS w
  FROM (SELECT item_id, size, names, unnest(range(1, len(names) - size + 2)) AS spot FROM b)
),
item AS (
  SELECT item_id, size, spot, array_to_string(w, ' ') AS win, len(list_filter(w, lambda x: x[1] = chr(1))) > 0 AS slots
  FROM bw WHERE len(list_filter(w, lambda x: x[1] <> chr(1))) >= least(4, ceil(size / 2))
),
total AS (SELECT item_id, count(DISTINCT spot) AS n_windows FROM item GROUP BY ALL),
dw AS (
  SELECT doc_id, size, place, array_to_string(list_slice(names, place, place + size - 1), ' ') AS win FROM (
    SELECT doc_id, names, size, unnest(range(1, len(names) - size + 2)) AS place FROM d, (SELECT DISTINCT size FROM item))
),
line AS (
  SELECT doc_id, item_id, place - spot AS shift, list(DISTINCT spot) AS ats, max(size) AS size, bool_or(slots) AS slots,
    list(DISTINCT spot) FILTER (WHERE NOT slots) AS literal
  FROM dw JOIN item USING (size, win) GROUP BY ALL
),
pair AS (
  SELECT DISTINCT doc_id, item_id, shift, b.raw[p] AS x, d.raw[p + shift] AS y FROM (
    SELECT doc_id, item_id, shift, spot + unnest(range(0, size)) AS p FROM (SELECT *, unnest(ats) AS spot FROM line WHERE slots))
  JOIN d USING (doc_id) JOIN b USING (item_id) WHERE b.raw[p][1] = chr(1)
),
kept AS (
  SELECT doc_id, item_id, literal AS ats, false AS changed FROM line WHERE literal IS NOT NULL
  UNION ALL
  SELECT doc_id, item_id, ats, changed FROM line JOIN (
    SELECT doc_id, item_id, shift, bool_or(x <> y) AS changed FROM pair GROUP BY ALL
    HAVING count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y)) USING (doc_id, item_id, shift)
)
SELECT doc_id, item_id, n_matched, n_windows, n_matched / n_windows AS coverage, changed FROM (
  SELECT doc_id, item_id, count(DISTINCT spot) AS n_matched, bool_or(changed) AS changed
  FROM (SELECT doc_id, item_id, changed, unnest(ats) AS spot FROM kept) GROUP BY ALL)
JOIN total USING (item_id) WHERE n_matched / n_windows >= 0.3
"""

# CRC-32 bit by bit: each byte comes in at the first of its eight steps.
CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(8 * len({0})), lambda i:
  CASE WHEN i % 8 = 0 THEN CAST(ascii(substr({0}, CAST(i // 8 AS INTEGER) + 1, 1)) AS BIGINT) ELSE 0 END)),
  lambda s, c: xor(xor(s, c) >> 1, 3988292384 * (xor(s, c) & 1))), 4294967295)"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, sha256(length(r) || ':' || r || t) AS said, length(t) AS n_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
),
own AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM turns GROUP BY conv_id),
lent AS (SELECT o.*, least(o.h, coalesce(b.n, 0)) AS lent FROM own o LEFT JOIN own b ON b.conv_id = o.base),
rebuilt AS (
  SELECT l.conv_id, t.i AS place, said, n_chars FROM lent l JOIN turns t ON t.conv_id = l.base AND t.i < l.lent
  UNION ALL
  SELECT l.conv_id, t.i - h + lent, said, n_chars FROM lent l JOIN turns t ON t.conv_id = l.conv_id AND t.i >= h
),
member AS (
  SELECT conv_id, place + 1 AS depth, n_chars, max(place + 1) OVER (PARTITION BY conv_id) AS turns,
    string_agg(said, ' ') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, coalesce((SELECT max(place + 1) FROM rebuilt r WHERE r.conv_id = own.conv_id), 0), '' FROM own
),
node AS (
  SELECT depth, sha256(prefix) AS key, min(conv_id) AS conv_id, count(*) AS n_convs, min(n_chars) AS n_chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM member GROUP BY ALL
),
-- Each node meets the nodes above it, and itself, along the way of its smallest member.
up AS (
  SELECT n.depth, n.key, a.depth AS above_depth, sha256(a.prefix) AS above_key FROM node n
  JOIN member a ON a.conv_id = n.conv_id AND a.depth <= n.depth
),
kids AS (SELECT above_depth AS depth, above_key AS key, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY ALL),
totals AS (
  SELECT above_depth AS depth, above_key AS key, count(*) FILTER (WHERE coalesce(n_children, 0) = 0) AS n_leaves,
    CAST(sum((n_convs - 1) * n_chars) AS BIGINT) AS saved_tokens
  FROM up JOIN node USING (depth, key) LEFT JOIN kids USING (depth, key) GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN totals USING (depth, key) LEFT JOIN kids USING (depth, key)
LEFT JOIN up u ON u.depth = n.depth AND u.key = n.key AND u.above_depth = n.depth - 1
LEFT JOIN node p ON p.depth = u.above_depth AND p.key = u.above_key
"""

ORACLES: dict[str, str] = {"op2_benchmark_decontamination": LEAKS, "op5_chat_quotations": CHAT, "op10_warc_bundles": WARC, "op13_prefix_trie": TRIE}


def oracle_sql() -> dict[str, str]:
    return ORACLES
