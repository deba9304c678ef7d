"""DuckDB SQL of the two conversation queries; ``CRC32`` is the checksum of an ASCII text, which DuckDB lacks."""

# the 256 table entries; a query folds the bytes of a text over them
CRC32 = """
crc_table AS MATERIALIZED (
  SELECT list(e ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS e
    FROM (SELECT unnest(range(256)) AS i))
)"""


_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11_SQL = f"""
WITH RECURSIVE {CRC32},
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS code FROM conversations
), kinds AS (
  SELECT code, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(code) + 1),
    lambda p: ord(substr(code, p, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM (SELECT DISTINCT code FROM coded), crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded JOIN kinds USING (code) WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, {_TRIM}) AS said, substr(role, 1, 1) AS initial FROM damaged
), rows_ AS (
  SELECT conv_id, turn, n, role, text, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    CASE WHEN said = '' THEN 1 WHEN again THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM ordered
), base AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
), dp AS (
  -- cheapest (cost, audit, text) of having kept nothing, a system, a user or an assistant row last; inserts done
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'a': '', 'x': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, x VARCHAR) AS s1,
    {{'c': 3, 'a': 'I', 'x': 'user:'}} AS s2, {{'c': 6, 'a': 'II', 'x': 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, s0, s1, s2, list_min([s3, {{'c': s2.c + 3, 'a': s2.a || 'I', 'x': s2.x || chr(10) || 'assistant:'}}]) FROM (
    SELECT conv_id, n, s0, s1, s3, list_min([s2, {{'c': s0.c + 3, 'a': s0.a || 'I', 'x': 'user:'}},
        CASE WHEN s1 IS NOT NULL THEN {{'c': s1.c + 3, 'a': s1.a || 'I', 'x': s1.x || chr(10) || 'user:'}} END,
        {{'c': s3.c + 3, 'a': s3.a || 'I', 'x': s3.x || chr(10) || 'user:'}}]) AS s2 FROM (
      SELECT d.conv_id, r.n,
        {{'c': s0.c + 4, 'a': s0.a || 'D', 'x': s0.x}} AS s0,
        list_min([CASE WHEN s1 IS NOT NULL THEN {{'c': s1.c + 4, 'a': s1.a || 'D', 'x': s1.x}} END,
          CASE WHEN ok AND initial = 's' THEN {{'c': s0.c + p, 'a': s0.a || 'K', 'x': line}} END]) AS s1,
        list_min([{{'c': s2.c + 4, 'a': s2.a || 'D', 'x': s2.x}},
          CASE WHEN ok THEN {{'c': s0.c + p + e, 'a': s0.a || l, 'x': as_user}} END,
          CASE WHEN ok AND s1 IS NOT NULL THEN {{'c': s1.c + p + e, 'a': s1.a || l, 'x': s1.x || chr(10) || as_user}} END,
          CASE WHEN ok THEN {{'c': s3.c + p + e, 'a': s3.a || l, 'x': s3.x || chr(10) || as_user}} END]) AS s2,
        list_min([{{'c': s3.c + 4, 'a': s3.a || 'D', 'x': s3.x}},
          CASE WHEN ok AND initial = 'a' THEN {{'c': s2.c + p, 'a': s2.a || 'K', 'x': s2.x || chr(10) || line}}
               WHEN ok THEN {{'c': s2.c + p + 3, 'a': s2.a || 'R', 'x': s2.x || chr(10) || 'assistant:' || text}} END]) AS s3
      FROM dp d JOIN (
        SELECT *, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS p, role || ':' || text AS line,
          CASE WHEN initial = 'u' THEN 0 ELSE 3 END AS e, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS l,
          CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text AS as_user FROM rows_
      ) r ON r.n = d.n + 1 AND r.conv_id IS NOT DISTINCT FROM d.conv_id)))
, best AS (
  SELECT conv_id, list_min([s0, s3]) AS s FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c::BIGINT AS cost, s.a AS audit, sha256(s.x) AS repaired_sha256
FROM best b LEFT JOIN base ON base.conv_id IS NOT DISTINCT FROM b.conv_id
"""

OP13_SQL = f"""
WITH {CRC32},
ids AS (
  SELECT c, c - c % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(code) + 1),
    lambda p: ord(substr(code, p, 1))::BIGINT)), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS code FROM conversations WHERE conv_id IS NOT NULL), crc_table
), numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations
), rebuilt AS (
  SELECT c, 0 AS own, n, role, text FROM ids JOIN numbered ON conv_id = base AND n <= h
  UNION ALL
  SELECT c, 1, n, role, text FROM ids JOIN numbered ON conv_id = c AND n > h
), placed AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS n_bytes,
    string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS path, count(*) OVER (PARTITION BY c) AS len
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, n)
), paths AS (
  SELECT c, d, n_bytes, path, d = len AS last FROM placed
  UNION ALL
  SELECT c, 0, 0, '', c NOT IN (SELECT c FROM placed) FROM ids
), nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM paths GROUP BY d, path
), kin AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent FROM nodes n
  LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = left(n.path, 64 * (n.d - 1)::INTEGER)
), children AS (
  SELECT d - 1 AS d, parent AS path, count(*) AS n_children FROM kin WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT a.d, a.path, sum(x.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes x LEFT JOIN children k USING (d, path) JOIN paths a ON a.c = x.conv_id AND a.d <= x.d GROUP BY a.d, a.path
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  ends_sha256
FROM kin JOIN below USING (d, path) LEFT JOIN children USING (d, path)
"""
