"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The table of CRC-32 follows from its polynomial; texts are taken byte by byte from their hexadecimal form.
OP2 = """
WITH RECURSIVE bits(i, n, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE n < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8
), ids AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS k, n FROM documents, (VALUES (16), (17)) AS t(n)
), walk(k, n, x, at_, next_) AS (
  SELECT k, n, CAST(k AS HUGEINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ids
  UNION ALL
  SELECT k, n, x2, next_, CAST(floor((next_ + 1) * (2147483648.0::DOUBLE / CAST(x2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT k, n, next_, (x * 2862933555777941757 + 1) % 18446744073709551616 AS x2 FROM walk WHERE next_ < n) AS s
), shard AS (
  SELECT k, n, max(at_) AS s FROM walk GROUP BY k, n
)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM (
  SELECT d.doc_id, CAST(octet_length(encode(coalesce(d.text, ''))) + 1 AS BIGINT) AS size, 'key' AS law, CAST(a.s AS INTEGER) AS shard, CAST(b.s AS INTEGER) AS grown_shard,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(d.text, ''))), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
      lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS text_crc32
  FROM documents d CROSS JOIN crc_table
  JOIN shard a ON a.k = coalesce(d.doc_id, 0) AND a.n = 16
  JOIN shard b ON b.k = coalesce(d.doc_id, 0) AND b.n = 17
)
"""

#: Words at distance one share what is left without one letter each at the same place, or one is the other without a
#: letter. The remainder by 199 decides which words lose a letter.
OP11 = """
WITH RECURSIVE bits(i, n, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE n < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8
), found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents
), counted AS (
  SELECT d, w, count(*) AS n FROM found GROUP BY d, w
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(d || ':' || w)), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
    lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS h FROM counted CROSS JOIN crc_table
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS left_ FROM words, unnest(range(length(word))) AS t(i)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.left_ = b.left_ AND a.word <> b.word
  UNION
  SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.left_ = w.word
  UNION
  SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.left_ = w.word
), best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), walk(word, at_) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at_ WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, k.at_ AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.at_ AND e.form IS NULL
"""

OP12 = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first_id END AS refers_to FROM (
  SELECT page_id, payload_bytes, payload_digest, first_id, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS revisit FROM (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
  )
)
"""

ORACLES: dict[str, str] = {"op2_jump_sharding": OP2, "op11_spelling_variants": OP11, "op12_warc_bundles": OP12}
