"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import CHAR_LEAST, CHAR_LIMIT, CLASSES, COMMON_WORDS, REFERENCE_LEAST, WORD_LEAST, WORD_LIMIT

_W = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (h)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, list_sort(list_distinct(regexp_extract_all(line, {_W}))) AS ws FROM l),
d AS (SELECT row_number() OVER (ORDER BY min((doc_id, pos))) AS id, ws, len(ws) AS n FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT id, n, unnest(ws) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t GROUP BY word),
r AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS i FROM t JOIN c USING (word)),
p AS (SELECT * FROM r WHERE i <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p AS a JOIN p AS b ON a.word = b.word AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
late AS (SELECT DISTINCT b FROM pairs JOIN d AS x ON x.id = a JOIN d AS y ON y.id = b WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)),
m AS (SELECT s.doc_id, s.pos, s.line, len(s.ws) > 0 AS has_words, len(s.ws) > 0 AND (row_number() OVER (PARTITION BY s.ws ORDER BY s.doc_id, s.pos) > 1 OR late.b IS NOT NULL) AS gone FROM s LEFT JOIN d ON d.ws = s.ws LEFT JOIN late ON late.b = d.id),
o AS (SELECT doc_id, count(*) FILTER (WHERE has_words) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE x AS (SELECT min(doc_id) AS tid, text, regexp_extract_all(text, {_W}) AS ws FROM documents WHERE text IS NOT NULL GROUP BY text),
g AS (SELECT tid, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END AS gs FROM x WHERE len(ws) > 0),
u AS (SELECT tid, n, sh, count(*) AS w FROM (SELECT tid, len(gs) AS n, unnest(gs) AS sh FROM g) GROUP BY tid, n, sh),
e AS (SELECT a.tid AS a, b.tid AS b FROM u AS a JOIN u AS b ON a.sh = b.sh AND a.tid <> b.tid GROUP BY a.tid, b.tid, a.n, b.n HAVING 5 * sum(least(a.w, b.w)) >= 4 * (a.n + b.n - sum(least(a.w, b.w)))),
reach AS (SELECT tid AS a, tid AS b FROM x UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS tid, min(b) AS class_id FROM reach GROUP BY a)
SELECT documents.doc_id, CASE WHEN x.ws IS NULL OR len(x.ws) = 0 THEN documents.doc_id ELSE class_id END AS class_id FROM documents LEFT JOIN x ON documents.text = x.text LEFT JOIN c ON c.tid = x.tid
"""

MIXING = f"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_W})) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS key FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0) AS remaining, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS w_left FROM t WINDOW p AS (ORDER BY 3 * source_size * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, remaining * w > 3 * source_size * w_left AS stops FROM o),
g AS (SELECT source, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(sum(source_size) OVER () - sum(CASE WHEN stops THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE) * CAST(w AS DOUBLE) / CAST(sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM c),
r AS (SELECT s.doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM r
"""


FILTER_AUDIT = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        {{'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
          'D': regexp_matches(t, '[#$%&*|]'), 'E': first_id IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first_id)}} AS f FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
w AS (SELECT part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x AS filter_order FROM letters UNION ALL SELECT filter_order || x FROM o, letters WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS x, filter_order[:step - 1] AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
c AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS bad, regexp_matches(fails, '[' || before || '_]') AS gone, fails = x AS alone FROM s, w),
r AS (SELECT part, filter_order, step, x, CAST(sum(n) FILTER (WHERE NOT bad AND NOT gone) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE bad AND NOT gone) AS BIGINT) AS removed, CAST(sum(n) FILTER (WHERE bad AND gone) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (WHERE alone) AS BIGINT) AS unique_fails, CAST(sum(n) FILTER (WHERE bad AND NOT gone AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (WHERE bad AND NOT gone AND toxic) AS BIGINT) AS toxic_lost FROM c GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
all_docs AS (SELECT CAST(count(*) AS HUGEINT) AS nn, CAST(sum(len(ws)) AS HUGEINT) AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT row_number() OVER () AS qid, item_id, {_TERMS} AS ws FROM benchmark WHERE text IS NOT NULL),
a AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(ws) AS term FROM q) GROUP BY qid, item_id, term),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN a USING (term) GROUP BY rid, doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, all_docs GROUP BY term, nn),
i AS (SELECT rid, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * CAST(75 + (25 * n * nn) // ll AS BIGINT))) AS impact FROM p JOIN f ON f.term = p.term, all_docs),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM a JOIN i ON i.term = a.term GROUP BY qid, item_id, rid, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


def _quality_rules() -> str:
    classes = [f"length(regexp_replace(t, '{p}', '', 'g'))" for p in CLASSES.values()]
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON_WORDS.items()) + " END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_W}) AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep USING (doc_id, g)) GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, ws, {listed} AS common, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
  length(t) AS n_all, [{", ".join(classes)}] AS cl FROM d LEFT JOIN rw ON rw.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
hist AS (
  SELECT doc_id, lang, base_failed, n_words, 'c' AS kind, CAST(unnest(range(7)) AS VARCHAR) AS k, unnest(list_concat(cl, [n_symbols, n_all - word_chars, n_all - list_sum(cl) - n_symbols - (n_all - word_chars)])) AS v FROM f
  UNION ALL SELECT doc_id, lang, base_failed, n_words, 'w', CASE WHEN list_contains(common, w) THEN w ELSE '' END, count(*) FROM (SELECT *, unnest(list_transform(ws, lambda x: lower(x))) AS w FROM f WHERE common IS NOT NULL) GROUP BY ALL),
ref AS (SELECT lang, kind, k, sum(v) AS v FROM hist WHERE NOT base_failed AND lang IN (SELECT lang FROM f WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {REFERENCE_LEAST}) GROUP BY lang, kind, k),
q AS (SELECT lang, kind, k, v / sum(v) OVER (PARTITION BY lang, kind) AS q FROM ref),
p AS (SELECT doc_id, lang, kind, k, v / nullif(sum(v) OVER (PARTITION BY doc_id, kind), 0) AS p FROM hist),
pq AS (SELECT ids.doc_id, q.kind, coalesce(p.p, 0) AS p, q.q FROM (SELECT DISTINCT doc_id, lang, kind FROM p WHERE p IS NOT NULL) AS ids JOIN q ON q.lang = ids.lang AND q.kind = ids.kind LEFT JOIN p ON p.doc_id = ids.doc_id AND p.kind = q.kind AND p.k = q.k),
dist AS (SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS js FROM pq GROUP BY doc_id, kind)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {CHAR_LEAST} AND c.js > {CHAR_LIMIT}, false) AND NOT coalesce(n_words >= {WORD_LEAST} AND w.js > {WORD_LIMIT}, false) AS kept
FROM f LEFT JOIN dist AS c ON c.doc_id = f.doc_id AND c.kind = 'c' LEFT JOIN dist AS w ON w.doc_id = f.doc_id AND w.kind = 'w'
"""


QUALITY_RULES = _quality_rules()
