"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = r"'[^\x20\x09-\x0D]+'"
LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {WORDS}), []) AS w FROM documents),
windows AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 19], ' ')) AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY p ORDER BY doc_id, k) AS rn FROM windows) WHERE rn > 1),
removed AS (SELECT DISTINCT doc_id, k + j AS pos FROM later, range(20) AS t(j)),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS line, count(*) AS n FROM placed ANTI JOIN removed USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 400)) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS k FROM d)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY p) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, k, coalesce(k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) > 200, true)::INT AS new FROM twice),
grouped AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM marked),
spans AS (SELECT doc_id, min(k) AS a, max(k) + 200 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last_end + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {LETTERS}), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({LOWER}, {LETTERS}), []) AS w FROM benchmark),
passages AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS p, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM passages))),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN passages USING (p, n)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {WORDS}), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id, n
"""

#: crc32 of the decimal doc_id, a bit at a time: each byte is taken in, then eight bits are shifted out.
CRC = """xor(4294967295::BIGINT, list_reduce(
  list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
  lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1))))"""
#: Factor lengths 1, 2, 4, ... named for op11; a run of period q is proposed by the shortest factor of 8 or more that is no shorter than q.
FACTORS = 21


def op11() -> str:
    names, proposals = [], []
    for k in range(FACTORS):
        width = 1 << k
        if k:
            names.append(
                f"f{k} AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY f, g) AS f FROM "
                f"(SELECT doc_id, i, f, lead(f, {width // 2}) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f{k - 1}) WHERE g IS NOT NULL)")
        if width >= 8:
            proposals.append(f"SELECT doc_id, i, {width} AS width, lead(i) OVER (PARTITION BY doc_id, f ORDER BY i) - i AS q FROM f{k}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {WORDS}), []) AS w, {CRC} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, h // 10 % greatest(len(w), 1) AS a, 3 + h // 10 % 8 AS parts FROM d),
e AS (SELECT *, 1 + (n - a) // parts AS p FROM g),
words AS (
  SELECT doc_id, i, w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM e)),
f0 AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY word) AS f FROM words),
{', '.join(names)},
proposed AS ({' UNION ALL '.join(proposals)}),
islands AS (
  SELECT doc_id, i, width, q, i - row_number() OVER (PARTITION BY doc_id, width, q ORDER BY i) AS island FROM proposed WHERE q <= width),
runs AS (
  SELECT DISTINCT doc_id, min(i) AS start, max(i) + q + width - min(i) AS length, q AS period
  FROM islands GROUP BY doc_id, width, q, island HAVING max(i) + q + width - min(i) >= greatest(24, 3 * q)),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


SQL: dict[str, str] = {
    "op3_substring_dedup": OP3,
    "op5_suffix_dedup": OP5,
    "op7_decontamination": OP7,
    "op10_near_duplicates": OP10,
    "op11_periodic_runs": op11(),
}
