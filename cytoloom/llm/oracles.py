"""DuckDB SQL of the operators that SQL can express."""

from .quality_rules import FENCE, LOG_GAMMA, LOWER as LOWER_LIMITS, MIN_ROWS, MIN_WORDS, least_spread
from .secrets import ACCESS, ALLOWED, ASSIGN, CANDIDATE, CLASSES, HEX, SLUG, WINDOW

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
hits AS (SELECT r, i, p.n, item_id FROM p JOIN g USING (t, n)),
pos AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

_MEASURES = {
    "symbols_per_word": "(n_symbols + 0.5::DOUBLE) / (n_words + 1::DOUBLE)",
    "repeated_line_odds": "(n_dup_lines + 0.5::DOUBLE) / (n_lines - n_dup_lines + 0.5::DOUBLE)",
    "capitals_per_char": "(n_capitals + 0.5::DOUBLE) / (word_chars + 1::DOUBLE)",
    "chars_per_word": "word_chars::DOUBLE / n_words",
}


def _fences(level: int, keys: str) -> str:
    """f<level>: total, lowest and highest bucket of each measure by ``keys``."""
    by = f"{keys}, m" if keys else "m"
    spread = f"{FENCE} * greatest(b75 - b25, CASE m {' '.join(f"WHEN '{name}' THEN {least_spread(name)}" for name in _MEASURES)} END)"
    return f"""q{level} AS (SELECT {by}, max(total) AS total, min(CASE WHEN 4 * upto >= total THEN bucket END) AS b25, min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS b75
FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, sum(n) AS n FROM sk GROUP BY {by}, bucket)) GROUP BY {by}),
f{level} AS (SELECT {by}, total, b25 - {spread} AS low, b75 + {spread} AS high FROM q{level})"""


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT r, doc_id, lang, source, w, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM e),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
rep AS (SELECT r, count(DISTINCT x)::BIGINT AS k FROM (SELECT r, unnest([i, i + 1, i + 2]) AS x FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1) GROUP BY r),
v AS (SELECT m.*, coalesce(k, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (r)),
b AS (SELECT r, lang, source, n_words, m, ceil(ln(x) / {LOG_GAMMA!r}::DOUBLE)::INTEGER AS bucket
  FROM ({" UNION ALL ".join(f"SELECT r, lang, source, n_words, '{name}' AS m, {sql} AS x FROM v WHERE n_words > 0" for name, sql in _MEASURES.items())})),
sk AS (SELECT lang, source, m, bucket, count(*) AS n FROM b WHERE n_words >= {MIN_WORDS} GROUP BY ALL),
{_fences(0, "lang, source")}, {_fences(1, "lang")}, {_fences(2, "")},
o AS (SELECT r, bool_and(CASE WHEN f0.total >= {MIN_ROWS} THEN bucket <= f0.high AND (b.m NOT IN ({", ".join(f"'{x}'" for x in LOWER_LIMITS)}) OR bucket >= f0.low) WHEN f1.total >= {MIN_ROWS} THEN bucket <= f1.high AND (b.m NOT IN ({", ".join(f"'{x}'" for x in LOWER_LIMITS)}) OR bucket >= f1.low)
  ELSE bucket <= f2.high AND (b.m NOT IN ({", ".join(f"'{x}'" for x in LOWER_LIMITS)}) OR bucket >= f2.low) END) AS within
  FROM b LEFT JOIN f0 ON f0.lang IS NOT DISTINCT FROM b.lang AND f0.source IS NOT DISTINCT FROM b.source AND f0.m = b.m LEFT JOIN f1 ON f1.lang IS NOT DISTINCT FROM b.lang AND f1.m = b.m LEFT JOIN f2 ON f2.m = b.m GROUP BY r),
j AS (SELECT v.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(within, false) AS within FROM v LEFT JOIN o USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept FROM j
"""

OP4 = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(v, h, p)),
j AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v DESC) AS n
  FROM (SELECT row_number() OVER () AS k, * FROM u) LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1
"""

OP5 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS s, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM p),
d AS (SELECT *, list_transform(range(8), lambda g: ('0x' || s[g * 5 + 1:g * 5 + 5])::BIGINT) AS x FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((x[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


def _op3() -> str:
    quote = lambda p: p.replace("'", "''")

    def spans(rank: int, pattern: str, table: str = "d") -> str:
        """(r, rank, s, e, f) of the matches: their starts are sums of the lengths of pieces and matches before."""
        p = quote(pattern)
        return f"""SELECT r, {rank} AS rank, sum(length(q) + length(f)) OVER w - length(f) AS s, sum(length(q) + length(f)) OVER w AS e, f FROM
  (SELECT r, i, m[i] AS f, q[i] AS q FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS q, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM {table} WHERE regexp_matches(t, '{p}'))) WINDOW w AS (PARTITION BY r ORDER BY i)"""

    def blanked(pattern: str, where: str = "true") -> str:
        p = quote(pattern)
        return f"CASE WHEN regexp_matches(t, '{p}') THEN array_to_string(list_transform(list_zip(regexp_split_to_array(t, '{p}'), regexp_extract_all(t, '{p}')), lambda x: x[1] || coalesce(CASE WHEN {where.format('x[2]')} THEN repeat(' ', length(x[2])) ELSE x[2] END, '')), '') ELSE t END"

    enough = """length(regexp_extract({0}, '[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""
    limits = " ".join(f"WHEN regexp_matches(f, '{quote(p)}') THEN {'NULL' if limit is None else limit}" for p, limit in CLASSES.values())
    kind = "CASE rank WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({spans(0, ASSIGN)}) WHERE {enough.format("f")} UNION ALL {spans(1, ACCESS)} UNION ALL {spans(2, HEX)}),
l1 AS (SELECT r, {blanked(ASSIGN, enough)} AS t FROM d), l2 AS (SELECT r, {blanked(ACCESS)} AS t FROM l1), l3 AS (SELECT r, {blanked(HEX)} AS t FROM l2), l4 AS (SELECT r, {blanked(ALLOWED)} AS t FROM l3),
cand AS (SELECT c.*, CASE {limits} END AS lim FROM ({spans(3, CANDIDATE, "l4")}) c WHERE NOT regexp_matches(f, '{quote(SLUG)}')),
win AS (SELECT r, s, i, substr(f, (i + k)::BIGINT, 1) AS ch FROM (SELECT r, s, f, unnest(range(1, length(f) - {WINDOW} + 2)) AS i FROM cand WHERE lim IS NOT NULL), range({WINDOW}) x(k)),
ent AS (SELECT r, s, max(h) AS h FROM (SELECT r, s, i, sum(-n / {WINDOW}.0::DOUBLE * log2(n / {WINDOW}.0::DOUBLE)) AS h FROM (SELECT r, s, i, ch, count(*) AS n FROM win GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
every AS (SELECT r, rank, s, e FROM base UNION ALL SELECT r, rank, s, e FROM cand JOIN ent USING (r, s) WHERE h >= lim),
g AS (SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS x,
  string_agg({kind} || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 3) AS b, string_agg({kind} || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""


SQL = {"op3_secret_scan": _op3(), "op4_url_filter": OP4, "op5_warc": OP5, "op6_decontamination": OP6, "op10_quality_rules": OP10}
