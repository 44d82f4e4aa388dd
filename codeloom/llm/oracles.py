"""DuckDB SQL for the results of the queries."""

from __future__ import annotations

from codeloom.llm.quality_rules import LineRules
from codeloom.llm.url_filter import CONTRACT_RULES, PATTERN_RULES

B = r"[\x20\x09-\x0D]"


def _span_sql(kind: str, order: int, pattern: str, value: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS k, '{kind}' AS kind,
    CAST(coalesce(list_sum(list_transform(gaps[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS INT) AS s,
    length(ms[i]) AS n, vs[i] AS v
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {value}) AS vs FROM d),
    LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)"""


def _secrets() -> str:
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT * FROM ({_span_sql("assign", 0, assign, 2)}) WHERE length(v) >= 6
  UNION ALL SELECT * FROM ({_span_sql("access", 1, "AKIA[A-Z0-9]+", 0)}) WHERE n >= 20
  UNION ALL SELECT * FROM ({_span_sql("hex", 2, "[0-9a-f]{24,}", 0)})),
cand AS (SELECT * FROM ({_span_sql("live", 3, "[A-Za-z0-9_+=-]{20,}", 0)}) c
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.n AND c.s < b.s + b.n)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM cand),
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT owner || chr(0) || repo) AS repos FROM spans JOIN d USING (doc_id) GROUP BY v),
found AS (SELECT spans.*, owners <= 1 AND repos <= 3 AS live FROM spans JOIN owned USING (v)),
kept AS (SELECT * FROM found WHERE k < 3 OR live)
SELECT d.doc_id,
  count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k >= 0), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""


def _quality(r: LineRules, docs: str = "documents") -> str:
    phrases = "|".join(r.boilerplate)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{B}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 6)) AS i)),
hit AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, l, list_filter(string_split_regex(l, '{B}+'), lambda x: x <> '') AS lw FROM w, LATERAL (SELECT unnest(ls) AS l)),
feat AS (SELECT doc_id, l, len(lw) AS n, len(list_filter(lw, lambda x: regexp_full_match(x, '[|>»›·•/—-]+'))) AS alone,
  length(l) - length(regexp_replace(l, '[#*$%&<>^~=+@{{}}\\\\]', '', 'g')) AS symbols FROM line),
lost AS (SELECT doc_id, sum(length(regexp_replace(l, '{B}', '', 'g'))) AS lost FROM feat WHERE
  (n >= {r.unpunctuated_words} AND NOT regexp_matches(l, '\\p{{P}}'))
  OR (alone >= {r.least_separators} AND alone * {r.words_per_separator} >= n)
  OR (symbols >= {r.least_symbols} AND symbols * {r.words_per_symbol} >= n)
  OR (n >= {r.shouting_words} AND regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '\\p{{Ll}}'))
  OR (n <= {r.boilerplate_words} AND regexp_matches(l, '(?i)({phrases})')) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{B}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND lost_chars * 100 <= word_chars * {r.lost_percent} AS kept FROM m"""


def _jaccard(docs: str, n: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM {docs} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM {docs} d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""


def _decontaminate(docs: str = "documents") -> str:
    return rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {docs}),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT *, least(len(ws), 13) AS m FROM bw), LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i) WHERE m > 0),
lens AS (SELECT DISTINCT m FROM p),
runs AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM dw, lens, LATERAL (SELECT unnest(range(1, len(ws) - m + 2)) AS i)),
hits AS MATERIALIZED (SELECT doc_id, m, i, item FROM runs JOIN p USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT doc_id, m, i FROM hits), LATERAL (SELECT unnest(range(m)) AS k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN covered c USING (doc_id) LEFT JOIN its USING (doc_id)"""


def _urls() -> str:
    rules = ", ".join(f"({k}, '{r.verdict}', '{r.host}', '{r.path}', '{r.text}')" for k, r in enumerate(CONTRACT_RULES))
    anyof = {v: " OR ".join(f"coalesce(regexp_matches(url, '{_re2(r.pattern)}'), false)" for r in PATTERN_RULES if r.verdict == v) for v in ("allow", "block")}
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(k, verdict, rhost, rpath, rule) AS (VALUES {rules}),
best AS (SELECT page_id, rule, verdict FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, k) = 1)
SELECT h.page_id, h.host, h.path, best.rule,
  coalesce(best.verdict, CASE WHEN {anyof["allow"]} THEN 'allow' WHEN {anyof["block"]} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best USING (page_id)"""


def _re2(pattern: str) -> str:
    """RE2 has no look-ahead; the end of a host reads the same as an alternative there."""
    return pattern.replace("(?=[/?#]|$)", "([/?#]|$)")


#: The order of rows within a source or shard: the first 15 hexadecimal digits of an MD5 of id and text.
ORDER = "CAST('0x' || md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, '')))[1:15] AS BIGINT)"
#: The table of the CRC of a byte, and the CRC of a text by it.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)))"


def _mixing(docs: str, block_rows: int = 16) -> str:
    """Slots by earliest deadline first, one step of the recursion for each slot of a period; places by slot and row."""
    return f"""
WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE concat('+', source) END AS s, {ORDER} AS ord FROM {docs}),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) - 1 AS r FROM o),
n AS (SELECT s, count(*) AS n FROM o GROUP BY s),
w AS MATERIALIZED (SELECT s, greatest(1, CAST(floor(64 * sqrt(n / (SELECT max(n) FROM n)) + 0.5) AS BIGINT)) AS c FROM n),
src AS MATERIALIZED (SELECT list(s ORDER BY s) AS names, list(c // g ORDER BY s) AS ws, CAST(sum(c // g) AS BIGINT) AS total FROM w, (SELECT list_reduce(list(c), lambda x, y: gcd(x, y)) AS g FROM w)),
sim(t, pick, k, nxt) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)) FROM src
  UNION ALL SELECT t + 1, p, nxt[p], list_transform(nxt, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END) FROM (SELECT t, nxt, CAST(list_position(due, list_min(due)) AS BIGINT) AS p FROM (
    SELECT t, nxt, list_transform(nxt, lambda v, i: CASE WHEN v < ws[i] AND (v * total) // ws[i] <= t + 1 THEN ((v + 1) * total + ws[i] - 1) // ws[i] ELSE 9000000000000000000 END) AS due FROM sim, src WHERE t + 1 < total))),
slots AS MATERIALIZED (SELECT names[pick] AS s, ws[pick] AS c, k, t, total FROM sim, src WHERE t >= 0)
SELECT doc_id, source, CAST(r // {block_rows} AS BIGINT) AS mix_block, CAST(((r // {block_rows}) // c) * total + t AS BIGINT) AS mix_slot,
  CAST(row_number() OVER (ORDER BY ((r // {block_rows}) // c) * total + t, r) - 1 AS BIGINT) AS mix_position
FROM b JOIN slots ON slots.s = b.s AND slots.k = (b.r // {block_rows}) % slots.c"""


def _resharded(rows: str, shards: int) -> str:
    """Of rows (doc_id, size, old, ord, ...) the shard and slot: what a shard can keep stays, the rest fills shards in order."""
    return f"""
WITH rows_ AS MATERIALIZED ({rows}), total AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM rows_),
caps AS (SELECT CAST(j AS BIGINT) AS j, total // {shards} + CASE WHEN j < total % {shards} THEN 1 ELSE 0 END AS cap FROM range({shards}) z(j), total),
held AS (SELECT old, CAST(sum(size) AS BIGINT) AS b FROM rows_ GROUP BY old),
kept AS MATERIALIZED (SELECT old, j, coalesce(b, 0) AS b, coalesce(cap, 0) AS cap, least(coalesce(b, 0), coalesce(cap, 0)) AS stay FROM held FULL JOIN caps ON old = j),
sup AS (SELECT old, stay, b - stay AS x, sum(b - stay) OVER (ORDER BY old) AS until FROM kept WHERE old IS NOT NULL),
dem AS (SELECT j, cap - stay AS y, sum(cap - stay) OVER (ORDER BY j) AS until FROM kept WHERE j IS NOT NULL),
arcs AS (SELECT old, j, sup.stay, least(sup.until, dem.until) - greatest(sup.until - x, dem.until - y) AS n FROM sup JOIN dem ON sup.until - x < dem.until AND dem.until - y < sup.until),
cuts AS (SELECT old, j, stay + sum(n) OVER (PARTITION BY old ORDER BY j) - n AS lo, stay + sum(n) OVER (PARTITION BY old ORDER BY j) AS hi FROM arcs UNION ALL SELECT old, old, 0, stay FROM kept WHERE stay > 0),
ahead AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY old ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size // 2 AS middle FROM rows_)
SELECT ahead.* EXCLUDE (middle), CAST(j AS INT) AS shard, CAST(row_number() OVER (PARTITION BY j ORDER BY ord) - 1 AS BIGINT) AS slot FROM ahead JOIN cuts ON cuts.old = ahead.old AND lo <= middle AND middle < hi"""


def _op8() -> str:
    rows = f"SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {_crc('text')} AS text_crc32, ({_crc('source')}) % 20 AS old, {ORDER} AS ord FROM documents, crc"
    return f"WITH {CRC_TABLE} SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, slot, CAST(NULL AS INT) AS grown_shard, CAST(old AS INT) AS old_shard, old <> shard AS moved FROM ({_resharded(rows, 24)})"


def pipeline(shards: int = 24, stretches: int = 20) -> str:
    """The five stages one after the other, over documents whose ids are unique."""
    rows = f"SELECT cleaned.*, strlen(coalesce(text, '')) + 8 AS size, {_crc('text')} AS text_crc32, (mix_position * {stretches}) // (SELECT count(*) FROM cleaned) AS old, mix_position AS ord FROM cleaned JOIN mix USING (doc_id), crc"
    return f"""
WITH {CRC_TABLE}, good AS MATERIALIZED (SELECT documents.* FROM documents JOIN ({_quality(LineRules())}) k USING (doc_id) WHERE k.kept),
first_ AS MATERIALIZED (SELECT good.* FROM good JOIN ({_jaccard("good", 5, 80)}) k USING (doc_id) WHERE k.component_id = doc_id),
cleaned AS MATERIALIZED (SELECT first_.* FROM first_ JOIN ({_decontaminate("first_")}) k USING (doc_id) WHERE NOT k.contaminated),
mix AS MATERIALIZED (SELECT doc_id, mix_position FROM ({_mixing("cleaned")}))
SELECT doc_id, text, lang, source, n_chars, size, text_crc32, 'bytes' AS law, shard, slot FROM ({_resharded(rows, shards)})"""


SQL = {
    "op3_secret_scan": _secrets(),
    "op4_quality_rules": _quality(LineRules()),
    "op5_ngram_jaccard_join": _jaccard("documents", 4, 85),
    "op7_benchmark_decontamination": _decontaminate(),
    "op8_sharding": _op8(),
    "op9_source_mixing": f"SELECT doc_id, source, mix_block, mix_slot, mix_position FROM ({_mixing('documents')})",
    "op10_url_filter": _urls(),
}
