"""SQL of the queries whose results are plain functions of their tables."""

import string

_LATEST = "max(page_id) OVER (PARTITION BY html)"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, {_LATEST} AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN latest END AS refers_to
FROM b"""

_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SUBSTRINGS = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM t)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept k ON t.doc_id = k.doc_id"""

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
JACCARD = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a, b FROM either UNION SELECT r.a, e.b FROM reached AS r JOIN either AS e ON e.a = r.b)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(m, t.doc_id)) AS component_id
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) AS c ON c.a = t.doc_id"""

# crc32 by shifts and xors, over the decimal digits of the id
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)::BIGINT"

RUNS = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w, {_CRC} AS h FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS times FROM t),
p AS (SELECT *, 1 + (n - a) // times AS p FROM g),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN again AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words AS x JOIN words AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told,
  arg_min({{'start': start, 'length': length, 'period': period}}, [-length, start, period]) AS b FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL) AS kept FROM words AS x LEFT JOIN gone AS g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
  CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id"""

_TERMS = "regexp_extract_all(translate(text, '" + _UPPER + "', '" + _LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED = f"""
WITH d AS (SELECT *, len(w) AS n, row_number() OVER () AS r FROM (SELECT doc_id, {_TERMS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY ALL),
p AS (SELECT r, doc_id, term, count(*) AS tf, 75 + (25 * n * docs) // terms AS m FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d), s WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
scores AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM p JOIN w USING (term) JOIN q USING (term) GROUP BY item_id, r, doc_id),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20"""

ORACLES = {"op11_ranked_search": RANKED, "op13_periodic_runs": RUNS, "op2_warc_revisits": WARC, "op3_substring_dedup": SUBSTRINGS, "op10_ngram_jaccard_join": JACCARD}
