"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(list_slice(w, s + 1, s + least(10, len(w))), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)
),
widths AS (SELECT DISTINCT width FROM iw),
dw AS (
  SELECT doc_id, s, width, array_to_string(list_slice(w, s + 1, s + width), ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(range(0, len(w) - width + 1)) AS s FROM d, widths WHERE len(w) >= width)
),
h AS (SELECT DISTINCT doc_id, s, dw.width, item_id FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.width = iw.width),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

# A SHA-1 is four times 40 bits; 40 bits are ten hex digits or eight base32 digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * i + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for i in range(4) for j in range(8)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""



def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the rule of the reflected polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


SHARDS = f"""
WITH t AS MATERIALIZED (SELECT CAST({_crc_table()} AS BIGINT[]) AS tab),
d AS (SELECT doc_id, text, CAST(strlen(coalesce(text, '')) AS BIGINT) + 16 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, CASE WHEN text IS NOT NULL THEN
  xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) END AS text_crc32 FROM d, t),
e AS (SELECT *, CAST(sum(size) OVER w AS BIGINT) - size AS below, row_number() OVER w - 1 AS pos FROM c WINDOW w AS (ORDER BY doc_id)),
total AS (SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM c),
edges AS (SELECT below, pos FROM e UNION ALL SELECT bytes, n FROM total),
cuts AS (
  SELECT i, arg_min(pos, (abs(below - (bytes * i) // 40), pos)) AS cut FROM total, (SELECT unnest(range(1, 40)) AS i), edges GROUP BY i
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(count(cut) AS INTEGER) AS shard, CAST(pos - coalesce(max(cut), 0) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM e LEFT JOIN cuts ON cut <= pos GROUP BY doc_id, size, text_crc32, pos
"""

_SHINGLES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) AS i FROM w WHERE len(w) > 0)
),
"""

NEAR_DUPLICATES = f"""
{_SHINGLES}
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT a AS doc_id, b AS seen FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a),
m AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
