"""DuckDB SQL for the rows of the corpus queries, written apart from the operators: other plans for the same results."""

#: Groups of equal texts.
EXACT_DEDUP = r"""
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Groups packed one by one into sixteen remaining capacities, for each capacity that may be tried; CRC-32 by its table.
SHARDS = r"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS z),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, sha256(coalesce(text, '')) AS g FROM documents),
h AS (SELECT g, any_value(hex(encode(coalesce(text, '')))) AS h FROM documents JOIN d USING (doc_id) GROUP BY g),
y AS (SELECT g, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) AS y FROM h),
x AS (SELECT g, xor(list_reduce(y, lambda c, k: xor(z[xor(c, k) % 256 + 1], c >> 8), 4294967295), 4294967295) AS crc FROM y, z),
g AS (SELECT g, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY g),
u AS (SELECT (CAST(sum(size) AS BIGINT) + 15) // 16 AS mean, max(size) AS largest FROM g),
o AS (SELECT g, size, row_number() OVER (ORDER BY size DESC, g) AS nth FROM g),
c AS (SELECT more, greatest(mean, largest) * (1024 + more) // 1024 AS capacity FROM u, (SELECT unnest(list_concat(range(65), list_transform(range(1, 9), lambda k: 64 << k))) AS more)),
b AS (
  SELECT more, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS shard, list_transform(range(16), lambda x: capacity) AS room FROM c
  UNION ALL
  SELECT more, nth, p, list_concat(list_concat(room[: p - 1], [room[p] - size]), room[p + 1 :])
  FROM (SELECT more, o.nth, o.size, room, list_position(room, list_min(list_filter(room, lambda x: x >= o.size))) AS p FROM b JOIN o ON o.nth = b.nth + 1)
  WHERE p IS NOT NULL AND p > 0
), f AS (SELECT min(more) AS more FROM b WHERE nth = (SELECT count(*) FROM o)),
a AS (SELECT o.g, CAST(b.shard - 1 AS INT) AS shard FROM o JOIN b USING (nth) JOIN f USING (more))
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN a USING (g) JOIN x USING (g)
"""

#: The whole queue of all copies in one order; seed 17, chunks of 1000 equal rows.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    sha256(concat_ws('#', coalesce(sha256(CAST(doc_id AS VARCHAR)), 'null'), coalesce(sha256(text), 'null'), coalesce(sha256(lang), 'null'),
      coalesce(sha256(source), 'null'), coalesce(sha256(CAST(n_chars AS VARCHAR)), 'null'))) AS key
  FROM documents
), g AS (SELECT key, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(size) AS size, count(*) AS n FROM d GROUP BY key),
c AS (SELECT *, unnest(range((n + 999) // 1000)) AS chunk FROM g),
u AS (SELECT *, least(1000, n - chunk * 1000) AS times, CAST('0x' || substr(md5(concat_ws('#', '17', key, chunk)), 1, 15) AS BIGINT) AS u FROM c),
s0 AS (SELECT source, CAST(sum(size * times) AS BIGINT) AS source_size FROM u GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, 1 + rank % 3 AS weight FROM s1),
s3 AS (
  SELECT *, budget - coalesce(sum(3 * source_size) OVER (scarce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (scarce ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER scarce AS place
  FROM s2 WINDOW scarce AS (ORDER BY source_size / weight, rank)
), s4 AS (SELECT min(place) AS place FROM s3 WHERE rest * weight <= 3 * source_size * weights),
s AS (
  SELECT s3.source, s3.rank, s3.source_size, s3.budget,
    CASE WHEN s3.place < s4.place THEN CAST(3 * s3.source_size AS DOUBLE) ELSE CAST(cut.rest * s3.weight AS DOUBLE) / CAST(cut.weights AS DOUBLE) END AS target
  FROM s3, s4 LEFT JOIN s3 AS cut ON cut.place = s4.place
), p AS (
  SELECT u.*, s.rank, s.source_size, s.target, s.budget,
    sum(size * times) OVER (PARTITION BY rank ORDER BY u, key, chunk ROWS UNBOUNDED PRECEDING) - size * times AS before
  FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source
), r AS (SELECT *, unnest(range(1, times + 1)) AS nth FROM p),
e AS (SELECT *, unnest(range(3)) AS epoch FROM r),
f AS (SELECT *, CAST(epoch * source_size + before + nth * size AS DOUBLE) / target AS finish FROM e
  WHERE size > 0 AND target > 0 AND CAST(epoch * source_size + before + (nth - 1) * size AS DOUBLE) < target),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS spent FROM f),
t AS (SELECT key, chunk, nth, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE spent <= budget GROUP BY key, chunk, nth)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken FROM r LEFT JOIN t USING (key, chunk, nth)
"""

#: Every 100-byte string of every text; those that are not the first of their kind cover bytes.
SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, length(h) // 2 - 99))) AS k FROM d)),
c AS (SELECT doc_id, k FROM p QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
n AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100, true) AS new FROM c),
g AS (SELECT doc_id, k, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM n),
r AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM r),
o AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM q JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""

#: Matches by cutting texts before each; terms by document counts over all pairs.
PERSONAL_DATA = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
shapes AS (SELECT * FROM (VALUES (1, 'email'), (2, 'ip'), (3, 'card'), (4, 'phone'), (5, 'term')) AS v(k, kind)),
cut AS (
  SELECT r, 1 AS k, string_split(regexp_replace(t, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', chr(1114109) || '\1', 'g'), chr(1114109)) AS l FROM d
  UNION ALL SELECT r, 2, string_split(regexp_replace(t, '([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))', chr(1114109) || '\1', 'g'), chr(1114109)) FROM d
  UNION ALL SELECT r, 3, string_split(regexp_replace(t, '([0-9](?:[\x20-]?[0-9])+)', chr(1114109) || '\1', 'g'), chr(1114109)) FROM d
  UNION ALL SELECT r, 4, string_split(regexp_replace(t, '(\+[0-9][\x20().0-9-]+[0-9])', chr(1114109) || '\1', 'g'), chr(1114109)) FROM d
  UNION ALL SELECT r, 5, string_split(regexp_replace(t, '([\p{L}\p{Nl}\p{No}]{4,})', chr(1114109) || '\1', 'g'), chr(1114109)) FROM d
), piece AS (SELECT r, k, unnest(l) AS p, generate_subscripts(l, 1) AS nth FROM cut),
placed AS (SELECT r, k, p, nth, CAST(sum(length(p)) OVER (PARTITION BY r, k ORDER BY nth) - length(p) AS BIGINT) AS a FROM piece),
found AS (
  SELECT r, k, kind, a, CASE k
    WHEN 1 THEN regexp_extract(p, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 2 THEN regexp_extract(p, '^[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
    WHEN 3 THEN regexp_extract(p, '^[0-9](?:[\x20-]?[0-9])+') WHEN 4 THEN regexp_extract(p, '^\+[0-9][\x20().0-9-]+[0-9]') ELSE regexp_extract(p, '^[\p{L}\p{Nl}\p{No}]{4,}') END AS x
  FROM placed JOIN shapes USING (k) WHERE nth > 1
), digits AS (SELECT *, a + length(x) AS b, regexp_replace(x, '[^0-9]', '', 'g') AS n FROM found),
entity AS (
  SELECT r, k, kind, a, b, x FROM digits
  WHERE k = 1
    OR k = 2 AND list_bool_and(list_transform(string_split(x, '.'), lambda o: length(ltrim(o, '0')) <= 3 AND coalesce(try_cast(ltrim(o, '0') AS INT), 0) <= 255))
    OR k = 3 AND length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(n)), lambda i: CAST(n[length(n) - i] AS INT) * (1 + i % 2) - CASE WHEN CAST(n[length(n) - i] AS INT) * (1 + i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
    OR k = 4 AND length(n) BETWEEN 8 AND 15
), total AS (SELECT count(*) AS n FROM d),
word AS (SELECT r, a, b, lower(x) AS term FROM digits WHERE k = 5),
c AS (SELECT term, count(DISTINCT r) AS c_t FROM word GROUP BY term),
holds AS (SELECT DISTINCT r, x AS entity FROM entity),
e AS (SELECT entity, count(*) AS c_e FROM holds GROUP BY entity HAVING count(*) < (SELECT n FROM total)),
outside AS (SELECT * FROM word WHERE r IN (SELECT r FROM holds) AND NOT EXISTS (SELECT 1 FROM entity WHERE entity.r = word.r AND entity.a < word.b AND entity.b > word.a)),
wording AS (SELECT r, string_agg(term, ' ' ORDER BY a) AS mark FROM outside GROUP BY r),
pair AS (
  SELECT entity, term, count(*) AS both_, count(DISTINCT mark) AS wordings FROM holds JOIN (SELECT DISTINCT r, term FROM outside) USING (r) JOIN wording USING (r) GROUP BY entity, term
), told AS (
  SELECT entity, term FROM pair JOIN c USING (term) JOIN e USING (entity) WHERE greatest(both_, c_t) * (wordings + 1) <= 2 * both_ * wordings
), shown AS (SELECT DISTINCT r, term FROM holds JOIN told USING (entity) JOIN (SELECT DISTINCT r, term FROM outside) USING (r, term)),
base AS (SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS base, count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone FROM entity GROUP BY r),
more AS (SELECT r, string_agg('term:' || a || ':' || b, ',' ORDER BY a) AS more FROM outside JOIN shown USING (r, term) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, more) AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""

#: All pairs of different sets that share a shingle, and what can be reached over links.
NEAR_COPIES = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s
  FROM w WHERE len(w) > 0
), m AS (SELECT s, min(doc_id) AS node, count(*) AS copies, len(s) AS size FROM s GROUP BY s),
f AS (SELECT node, size, copies, unnest(s) AS g FROM m),
l AS (
  SELECT a.node AS a, b.node AS b, any_value(b.copies) AS copies FROM f AS a JOIN f AS b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node HAVING 9 * count(*) >= 4 * (any_value(a.size) + any_value(b.size))
), t AS (SELECT node AS a, node AS root FROM m UNION SELECT l.b, t.root FROM t JOIN l ON t.a = l.a WHERE t.root < l.b),
c AS (SELECT a AS node, min(root) AS root FROM t GROUP BY a),
k AS (SELECT a AS node, sum(copies) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM documents AS d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN m ON s.s = m.s LEFT JOIN c ON c.node = m.node LEFT JOIN k ON k.node = m.node
"""

#: Neighbours by the strings that lose one code point, five forms at most, each at least ten times as frequent; CRC-32 by its table.
SPELLING = r"""
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS z),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
s AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
b AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS h FROM s),
y AS (SELECT run, c, list_transform(range(length(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) AS y FROM b),
h AS (SELECT run, c, xor(list_reduce(y, lambda c, k: xor(z[xor(c, k) % 256 + 1], c >> 8), 4294967295), 4294967295) AS h FROM y, z),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY word HAVING length(word) >= 7 AND sum(c) >= 2),
g AS (SELECT word, n, unnest(range(length(word))) AS k FROM w),
x AS (SELECT DISTINCT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS less FROM g),
p AS (
  SELECT a.word AS word, b.word AS other, b.n AS other_n FROM x AS a JOIN x AS b ON a.k = b.k AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x AS a JOIN w AS b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM x AS a JOIN w AS b ON a.less = b.word
)
, m AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n, CASE WHEN best_n >= 10 * w.n THEN best END AS form FROM w LEFT JOIN m USING (word)),
t AS (SELECT a.word, a.form, a.n, a.n_near, a.form_n, b.form AS f2, c.form AS f3, d.form AS f4, e.form AS f5 FROM f AS a LEFT JOIN f AS b ON a.form = b.word LEFT JOIN f AS c ON b.form = c.word LEFT JOIN f AS d ON c.form = d.word LEFT JOIN f AS e ON d.form = e.word)
SELECT word, form, coalesce(f5, f4, f3, f2, form, word) AS root, n, n_near, form_n FROM t
"""

#: Dates by fixed places; offsets of a zone a day before and after a wall time; every row by itself.
STAMPS = r"""
WITH t AS (SELECT stamp_id, source, zone, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM stamps),
k AS (
  SELECT *, regexp_full_match(x, '[0-9]{10}|[0-9]{13}') AS epoch,
    coalesce(regexp_full_match(x, '(20[0-9][0-9]-[0-9]{2}-[0-9]{2}|20[0-9]{6}|[0-9]{2}\.[0-9]{2}\.20[0-9]{2}|[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}|[0-9]{2}/[0-9]{2}/20[0-9]{2})([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?( ?[AP]M)?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?'), false) AS dated
  FROM t
), f AS (
  SELECT stamp_id, source, zone, x, substr(x, 3, 1) = '/' AS slashed,
    CASE WHEN substr(x, 5, 1) = '-' THEN substr(x, 1, 10) WHEN substr(x, 3, 1) IN ('.', '/') THEN substr(x, 7, 4) || '-' || substr(x, 4, 2) || '-' || substr(x, 1, 2)
      WHEN substr(x, 3, 1) = ' ' THEN substr(x, 8, 4) || '-' || lpad(CAST((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', substr(x, 4, 3)) + 2) // 3 AS VARCHAR), 2, '0') || '-' || substr(x, 1, 2)
      ELSE substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2) END AS dm,
    CASE WHEN substr(x, 3, 1) = '/' THEN substr(x, 7, 4) || '-' || substr(x, 1, 2) || '-' || substr(x, 4, 2) END AS md,
    substr(x, CASE WHEN substr(x, 3, 1) = ' ' THEN 13 WHEN regexp_matches(x, '^[0-9]{8}') THEN 10 ELSE 12 END) AS clock
  FROM k WHERE dated
), g AS (
  SELECT *, CASE WHEN clock = '' THEN 0 ELSE CAST(substr(clock, 1, 2) AS INT) END AS h, CASE WHEN clock = '' THEN 0 ELSE CAST(substr(clock, 4, 2) AS INT) END AS m,
    CASE WHEN substr(clock, 6, 1) = ':' THEN CAST(substr(clock, 7, 2) AS INT) ELSE 0 END AS s, regexp_extract(clock, '[AP]M') AS half, regexp_extract(clock, 'Z|[+-].*') AS off
  FROM f
), c AS (
  SELECT *, CASE WHEN half = '' THEN h ELSE h % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END END AS hour,
    CASE WHEN off = 'Z' THEN 0 WHEN off <> '' THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(off[2:3] AS INT) * 60 + CAST(off[-2:] AS INT)) END AS mins,
    CASE WHEN half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END AND m <= 59 AND s <= 59 AND (off IN ('', 'Z') OR CAST(off[2:3] AS INT) <= 14 AND CAST(off[-2:] AS INT) <= 59) AS good
  FROM g
), d AS (SELECT stamp_id, source, zone, slashed, mins, unnest([1, 2]) AS way, try_cast(unnest([dm, md]) AS DATE) + to_hours(hour) + to_minutes(m) + to_seconds(s) AS wall FROM c WHERE good),
o AS (
  SELECT *, epoch_us(wall) AS w, epoch_us(timezone(zone, make_timestamptz(epoch_us(wall) - 86400000000))) - (epoch_us(wall) - 86400000000) AS before,
    epoch_us(timezone(zone, make_timestamptz(epoch_us(wall) + 86400000000))) - (epoch_us(wall) + 86400000000) AS after FROM d WHERE wall IS NOT NULL
), u AS (
  SELECT *, epoch_us(timezone(zone, make_timestamptz(w - before))) = w AS early, epoch_us(timezone(zone, make_timestamptz(w - after))) = w AS late FROM o
), r AS (
  SELECT stamp_id, source, slashed, way, CASE WHEN mins IS NOT NULL THEN w - CAST(mins AS BIGINT) * 60000000 WHEN late AND NOT early THEN w - after ELSE w - before END AS us,
    mins IS NULL AND CASE WHEN early AND late THEN before <> after ELSE NOT early AND NOT late END AS odd FROM u
), p AS (
  SELECT stamp_id, any_value(source) AS source, any_value(slashed) AS slashed, max(us) FILTER (way = 1) AS us1, max(us) FILTER (way = 2) AS us2, coalesce(bool_or(odd) FILTER (way = 1), false) AS odd1, coalesce(bool_or(odd) FILTER (way = 2), false) AS odd2
  FROM r GROUP BY stamp_id
), v AS (SELECT source, count(*) FILTER (us2 IS NULL) AS dm, count(*) FILTER (us1 IS NULL) AS md FROM p WHERE slashed GROUP BY source),
q AS (
  SELECT stamp_id, CASE WHEN NOT slashed OR us2 IS NULL OR us1 IS NULL OR us1 = us2 THEN 'plain' WHEN coalesce(dm, 0) = coalesce(md, 0) THEN 'default' ELSE 'votes' END AS rule, us1, us2, odd1, odd2, coalesce(dm > md, false) AS day
  FROM p LEFT JOIN v ON p.source IS NOT DISTINCT FROM v.source
)
SELECT stamp_id, CASE WHEN epoch THEN CAST(x AS BIGINT) * CASE WHEN length(x) = 10 THEN 1000000 ELSE 1000 END WHEN rule = 'plain' THEN coalesce(us1, us2) WHEN day THEN us1 ELSE us2 END AS utc_us,
  CASE WHEN epoch THEN 'epoch' ELSE coalesce(rule, 'bad') END AS rule, CASE WHEN rule = 'plain' THEN odd1 OR odd2 ELSE coalesce(rule IN ('votes', 'default'), false) END AS ambiguous
FROM k LEFT JOIN q USING (stamp_id)
"""
