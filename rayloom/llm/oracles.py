"""SQL for DuckDB of those operators that it can express."""

from __future__ import annotations

from .codes import ROUNDS
from .lines import MIN_PAGES, RATIO
from .mixing import CAP, SALTS, SEED, WEIGHTS
from .quality import RULES, STOP_WORDS
from .resample import BUCKETS, MIN_WORDS, PERCENT
from .resample import SEED as SEED_13

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule(r) -> str:
    checks = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
    return f"({r.over} < {r.at_least} OR ({' AND '.join(checks)}))"


_STOP = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
_share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END"

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, {_WORDS} w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') g FROM d, unnest(generate_series(1, len(w) - 4)) u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) n_repeat_words FROM r, range(5) v(k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, len(l) n_lines,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) n_stop_words FROM d LEFT JOIN c USING (doc_id)),
q AS (SELECT *, {_share("word_chars", "n_words")} mean_word_chars, {_share("n_symbols", "n_words")} symbol_ratio, {_share("n_stop_words", "n_words")} stop_ratio, {_share("n_dup_lines", "n_lines")} dup_line_ratio,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_rule, RULES))} kept FROM q
"""

_hex = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
_R = "source_size / weight, source IS NULL, source"

OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) draw, {_hex(f"'{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} % {SALTS} salt FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST({list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) weight, CAST(sum(source_size) OVER () AS BIGINT) total FROM s),
v AS (SELECT *, (total - coalesce({CAP} * CAST(sum(source_size) OVER (ORDER BY {_R} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0)) / sum(weight) OVER (ORDER BY {_R} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lvl FROM w),
f AS (SELECT lvl FROM v WHERE lvl * weight <= {CAP} * source_size ORDER BY {_R} LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(weight * coalesce((SELECT lvl FROM f), CAST('inf' AS DOUBLE)), CAST({CAP} * source_size AS DOUBLE)) END target FROM v),
i AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, salt, draw, doc_id) - 1 i, CASE WHEN source_size = 0 THEN 0.0 ELSE target / CAST(source_size AS DOUBLE) END r,
  {_hex(f"'{SEED}:offset:' || coalesce('s' || d.source, 'n')")} / 4294967296.0 u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(r) + floor((r - floor(r)) * (i + 1) + u) - floor((r - floor(r)) * i + u) AS BIGINT) * size taken FROM i
"""

OP7 = rf"""
WITH p AS (SELECT row_number() OVER () rid, page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') host,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script.*?</script|style.*?</style)>|<!--.*?-->', '', 'g'),
    '(?i)</?(p|br|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|table|tr|td|head|body|html)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]*\n[ \t\n]*', chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM pages),
l AS (SELECT rid, host, i, s[i] line, trim(s[i], ' ' || chr(9) || chr(13)) k FROM (SELECT rid, host, string_split(text, chr(10)) s FROM p), unnest(generate_series(1, len(s))) u(i)),
t AS (SELECT host, count(*) pages FROM p GROUP BY 1),
b AS (SELECT l.host, k FROM l JOIN t ON l.host IS NOT DISTINCT FROM t.host WHERE k <> '' GROUP BY l.host, k, pages HAVING count(DISTINCT rid) >= {MIN_PAGES} AND count(DISTINCT rid) > {RATIO} * pages),
x AS (SELECT l.*, b.k IS NOT NULL gone FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.k = b.k),
a AS (SELECT rid, count(*) FILTER (k <> '') n_lines, count(*) FILTER (gone) n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') kept FROM x GROUP BY 1)
SELECT page_id, host, coalesce(n_lines, 0) n_lines, coalesce(n_dropped, 0) n_dropped, sha256(coalesce(kept, '')) kept_sha256 FROM p LEFT JOIN a USING (rid)
"""

# distances and means of parts of eight components, as the embeddings here have
_D = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 9))
_NEAR = "SELECT rid, part, min({d} * 16 + entry) m FROM p JOIN b{i} USING (part) GROUP BY ALL"
_MEAN = ", ".join(f"CAST((sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, 9))


def _op12(rounds: int) -> str:
    steps = "".join(
        f"a{i} AS MATERIALIZED ({_NEAR.format(d=f'({_D})', i=i)}),\n"
        f"m{i} AS (SELECT part, m % 16 entry, [{_MEAN}] y FROM a{i} JOIN p USING (rid, part) GROUP BY ALL),\n"
        f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(y, c) c FROM b{i} LEFT JOIN m{i} USING (part, entry)),\n"
        for i in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, e[part * 8 + 1:part * 8 + 8] x FROM v, range(8) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, x c FROM (SELECT rid, row_number() OVER (ORDER BY vec_id, e) - 1 entry FROM v) JOIN p USING (rid) WHERE entry < 16),
{steps}z AS MATERIALIZED ({_NEAR.format(d=f'({_D})', i=rounds)}),
e AS MATERIALIZED (SELECT rid, string_agg(format('{{:02x}}', m % 16), '' ORDER BY part) code, CAST(sum(m // 16) AS BIGINT) error FROM z GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM v JOIN e USING (rid), h
"""


OP12 = _op12(ROUNDS)

# the CRC-32 of features by a table of 256 remainders, which stands in `tab`
OP13 = rf"""
WITH RECURSIVE k(n, i, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, i + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM k WHERE i < 8),
tab AS (SELECT list(c ORDER BY n) t FROM k WHERE i = 8),
x AS (SELECT true doc, row_number() OVER () rid, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
w AS MATERIALIZED (SELECT doc, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM x),
f AS MATERIALIZED (SELECT doc, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f FROM w),
g AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} b FROM (SELECT DISTINCT f FROM f), tab),
n AS (SELECT b, count(*) FILTER (doc) s, count(*) FILTER (NOT doc) t FROM f JOIN g USING (f) GROUP BY 1),
o AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM n) + {BUCKETS}) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM n) + {BUCKETS}) AS DOUBLE))) AS BIGINT) gain FROM n),
q AS (SELECT rid, CAST(count(*) AS BIGINT) n_features, CAST((sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) weight FROM f JOIN g USING (f) JOIN o USING (b) WHERE doc GROUP BY 1),
s AS (SELECT doc_id, len(w) n, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0)
  + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED_13}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) score FROM w LEFT JOIN q USING (rid) WHERE doc),
r AS (SELECT *, CASE WHEN n >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n >= {MIN_WORDS} ORDER BY score DESC, doc_id) END k, count(*) FILTER (n >= {MIN_WORDS}) OVER () able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * able // 100 THEN k END AS rank FROM r
"""

ORACLES = {"op4_mix_sources": OP4, "op7_line_dedup": OP7, "op9_quality_rules": OP9, "op12_vector_codes": OP12, "op13_resample": OP13}
