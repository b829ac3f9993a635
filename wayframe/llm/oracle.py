"""The corpus queries that SQL can express, for DuckDB: definitions, without the operators' methods."""

from __future__ import annotations

#: Jaccard similarity of sets of 5-word shingles, 0.8 or more; groups are connected texts.
NEAR = r"""WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
keyed AS (SELECT rid, doc_id, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS k, s FROM sets),
classes AS (SELECT k, count(*) AS copies, min(doc_id) AS least, any_value(s) AS s FROM keyed WHERE k IS NOT NULL GROUP BY k),
shingles AS MATERIALIZED (SELECT k, len(s) AS n, unnest(s) AS x FROM classes),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM shingles AS a JOIN shingles AS b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 9 * c >= 4 * (m + n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
groups AS (SELECT r.a AS k, min(c.least) AS least FROM reach AS r JOIN classes AS c ON c.k = r.b GROUP BY r.a),
counts AS (SELECT l.a AS k, sum(c.copies) AS links, count(*) AS texts FROM links AS l JOIN classes AS c ON c.k = l.b GROUP BY l.a)
SELECT y.doc_id, CASE WHEN y.k IS NULL THEN y.doc_id ELSE least(c.least, g.least) END AS class_id, CAST(coalesce(c.copies - 1 + coalesce(n.links, 0), 0) AS BIGINT) AS n_links, CAST(coalesce(n.texts, 0) AS BIGINT) AS n_texts
FROM keyed AS y LEFT JOIN classes AS c ON c.k = y.k LEFT JOIN groups AS g ON g.k = y.k LEFT JOIN counts AS n ON n.k = y.k"""

#: Bytes that a 200-byte string covers which starts anywhere else too; texts as hexadecimal digits, two a byte.
REPEATS = """WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT rid, p, md5_number(substring(x, 2 * p + 1, 400)) AS h FROM (SELECT rid, x, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS p FROM d) AS e),
hits AS (SELECT rid, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
fresh AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS f FROM hits),
islands AS (SELECT rid, p, sum(f) OVER (PARTITION BY rid ORDER BY p) AS g FROM fresh),
runs AS MATERIALIZED (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM islands GROUP BY rid, g),
gaps AS (SELECT rid, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS f, a AS t FROM runs UNION ALL SELECT d.rid, coalesce(max(r.b), 0), any_value(len(d.x) // 2) FROM d LEFT JOIN runs AS r ON r.rid = d.rid GROUP BY d.rid),
kept AS (SELECT g.rid, string_agg(substring(d.x, CAST(2 * g.f + 1 AS BIGINT), CAST(2 * (g.t - g.f) AS BIGINT)), '' ORDER BY g.f, g.t) AS x FROM gaps AS g JOIN d ON d.rid = g.rid GROUP BY g.rid),
sums AS (SELECT rid, sum(b - a) AS n, count(*) AS m FROM runs GROUP BY rid)
SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.m, 0) AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN kept AS k ON k.rid = d.rid LEFT JOIN sums AS s ON s.rid = d.rid"""

#: crc32 of the bytes of x, as hexadecimal digits, by its definition: a byte at a time, a bit at a time.
_BIT = "list_reduce(list_prepend({}, range(8)), lambda v, _: xor(v >> 1, (v & 1) * 3988292384))"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT))), lambda c, b: xor(c >> 8, " + _BIT.format("xor(c & 255, b)") + ")))"
#: Counts of words, symbols and repeats; the mean log ratio of n-grams' shares in good documents and in all of them, in 8192 buckets.
QUALITY = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^ 	-]+') AS w FROM d),
words AS MATERIALIZED (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS k, len(w) AS n FROM w),
ahead AS MATERIALIZED (SELECT r, k, n, x, lead(x, 1) OVER v AS x1, lead(x, 2) OVER v AS x2, lead(x, 3) OVER v AS x3, lead(x, 4) OVER v AS x4 FROM words WINDOW v AS (PARTITION BY r ORDER BY k)),
five AS (SELECT r, k, count(*) OVER (PARTITION BY r, x, x1, x2, x3, x4) AS c FROM ahead WHERE k <= n - 4),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + 5)) AS p FROM five WHERE c > 1) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ 	-]') GROUP BY r),
grams AS MATERIALIZED (SELECT r, x AS g FROM ahead UNION ALL SELECT r, x || ' ' || x1 FROM ahead WHERE k < n),
buckets AS MATERIALIZED (SELECT g, {_CRC} & 8191 AS b FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM grams))),
placed AS MATERIALIZED (SELECT g.r, b.b, d.good FROM grams AS g JOIN buckets AS b ON b.g = g.g JOIN d ON d.r = g.r),
counts AS (SELECT b, count(*) AS n, count(*) FILTER (good) AS m FROM placed GROUP BY b),
sums AS (SELECT sum(n) AS n, sum(m) AS m FROM counts),
ratios AS (SELECT b, ln((c.m + 1) / (s.m + 8192.0)) - ln((c.n + 1) / (s.n + 8192.0)) AS v FROM counts AS c, sums AS s),
scores AS (SELECT p.r, sum(v) AS s FROM placed AS p JOIN ratios AS q ON q.b = p.b GROUP BY p.r),
base AS (SELECT d.r, d.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, s.s / (2 * len(w.w) - 1) AS score
 FROM d JOIN w ON w.r = d.r LEFT JOIN lines AS l ON l.r = d.r LEFT JOIN covered AS c ON c.r = d.r LEFT JOIN scores AS s ON s.r = d.r),
failed AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score >= -0.1, true) AS kept, round(score, 6) AS score FROM failed"""

_DIGITS = lambda text, at, n: f"CAST('0x' || substr({text}, {at}, {n}) AS BIGINT)"  # noqa: E731
_WORDS = ", ".join(f"sum({_DIGITS('h', 8 * k + 1, 8)}) % 4294967296 AS f{k}" for k in range(8))
_DOT = lambda a, b: f"list_sum(list_transform(range(1, 129), lambda k: CAST({a}[k] AS DOUBLE) * CAST({b}[k] AS DOUBLE)))"  # noqa: E731
_NEAR = lambda a, b: f"CASE WHEN {a}.t = {b}.t THEN 1.0 WHEN {_DOT(f'{a}.sk', f'{a}.sk')} * {_DOT(f'{b}.sk', f'{b}.sk')} > 0 THEN least(1.0, greatest(0.0, {_DOT(f'{a}.sk', f'{b}.sk')} / sqrt({_DOT(f'{a}.sk', f'{a}.sk')} * {_DOT(f'{b}.sk', f'{b}.sk')}))) ELSE 0.0 END"  # noqa: E731
#: Sums of paragraphs' hashes, for documents, edited texts and next documents.
FINGERPRINTS = f"""WITH t AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT a.r, a.doc_id, a.text, b.r AS next, length(a.text) AS n, b.text AS following FROM t AS a JOIN t AS b ON b.r = a.r % (SELECT count(*) FROM t) + 1),
e AS MATERIALIZED (SELECT r, doc_id, next, n, text, substring(text, 1, n - n // 3) || substring(following, 1, n // 3) AS edited FROM n),
texts AS (SELECT r, 0 AS kind, text AS x FROM e UNION ALL SELECT r, 1, edited FROM e),
parts AS (SELECT r, kind, unnest(list_filter(string_split(regexp_replace(x, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)), lambda p: p <> '')) AS p FROM texts),
hashed AS MATERIALIZED (SELECT r, kind, sha256(p) AS h, {_DIGITS('md5(p)', 1, 2)} AS c FROM parts),
wide AS (SELECT r, kind, {_WORDS} FROM hashed GROUP BY r, kind),
lanes AS (SELECT r, kind, c & 127 AS lane, sum(CASE WHEN c >= 128 THEN -1 ELSE 1 END) AS s FROM hashed GROUP BY r, kind, lane),
maps AS (SELECT r, kind, map_from_entries(list(struct_pack(k := lane, v := CAST(s AS BIGINT)))) AS m FROM lanes GROUP BY r, kind),
vectors AS (SELECT x.r, x.kind, [{", ".join(f"CAST(coalesce(w.f{k}, 0) AS BIGINT)" for k in range(8))}] AS f, list_transform(range(0, 128), lambda k: coalesce(m.m[k], 0)) AS sk FROM texts AS x LEFT JOIN wide AS w ON w.r = x.r AND w.kind = x.kind LEFT JOIN maps AS m ON m.r = x.r AND m.kind = x.kind),
v AS MATERIALIZED (SELECT r, kind, sk, array_to_string(list_transform(f, lambda x: printf('%08x', x)), '') || '-' || array_to_string(list_transform(sk, lambda x: printf('%08x', CASE WHEN x < 0 THEN x + 4294967296 ELSE x END)), '') AS t FROM vectors)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, a.t AS fingerprint, b.t AS edited_fingerprint, {_NEAR('a', 'b')} AS near_edited, {_NEAR('a', 'c')} AS near_next
FROM e JOIN v AS a ON a.r = e.r AND a.kind = 0 JOIN v AS b ON b.r = e.r AND b.kind = 1 JOIN v AS c ON c.r = e.next AND c.kind = 0"""

ORACLE_SQL: dict[str, str] = {"op6_ngram_ratio": QUALITY, "op4_lsh_forest": NEAR, "op7_bwt_dedup": REPEATS, "op10_multiset_hash": FINGERPRINTS}
