"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from . import quality_rules, secrets


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"

ORACLES = {}

ORACLES["op9_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op5_mixing"] = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
t AS MATERIALIZED (SELECT source, sum(n_tokens) AS tokens FROM w GROUP BY source),
p AS MATERIALIZED (SELECT tokens, tokens / sum(tokens) OVER () AS share, count(*) OVER () AS k FROM t WHERE tokens > 0),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, if(even, (low + high) / 2, low), if(even, high, (low + high) / 2)
  FROM (SELECT any_value(step) AS step, any_value(low) AS low, any_value(high) AS high,
      (ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * ln(pow(share, (low + high) / 2))) / sum(pow(share, (low + high) / 2))) / ln(any_value(k)) >= 0.95 AS even
    FROM bisect, p WHERE step < 20 GROUP BY step)),
whole AS (SELECT -sum(share * ln(share)) / ln(any_value(k)) >= 0.95 AS even FROM p),
e AS (SELECT if((SELECT even FROM whole), 1.0, max(low)) AS t FROM bisect),
z AS (SELECT sum(pow(share, t)) AS z, sum(tokens) AS total FROM p, e),
q AS (SELECT source, tokens, CAST(floor(round(if(tokens > 0, pow(tokens / total, t) / z, 0) * total, 3)) AS BIGINT) AS quota FROM t, e, z),
r AS (SELECT source, if(tokens > 0, quota // tokens, 0) AS passes, quota - tokens * if(tokens > 0, quota // tokens, 0) AS rest FROM q),
ran AS (SELECT w.*, sum(n_tokens) OVER (PARTITION BY source ORDER BY key) AS upto FROM w)
SELECT doc_id, ran.source, n_tokens, CAST('0x' || substr(key, 1, 2) AS INTEGER) AS block,
  CAST(passes + CAST(upto <= rest AND tokens > 0 AS BIGINT) AS BIGINT) AS copies,
  CASE WHEN passes + CAST(upto <= rest AND tokens > 0 AS BIGINT) > 0 THEN substr(md5('mix|1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 4) END AS first_use_block
FROM ran JOIN r ON ran.source IS NOT DISTINCT FROM r.source JOIN t ON ran.source IS NOT DISTINCT FROM t.source
"""


def _matches(kind: int, pattern: str, value: int, keep: str) -> str:
    p = _quoted(pattern)
    return f"""
SELECT * FROM (
  SELECT *, sum(length(piece) + length(coalesce(found, ''))) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, source, lang, {kind} AS kind, unnest(string_split_regex(text, {p})) AS piece, unnest(regexp_extract_all(text, {p}, 0)) AS found,
      unnest(regexp_extract_all(text, {p}, {value})) AS val, unnest(range(len(string_split_regex(text, {p})))) AS i
    FROM documents WHERE regexp_matches(text, {p})))
WHERE found IS NOT NULL AND {keep}"""


ORACLES["op6_secrets"] = f"""
WITH base AS MATERIALIZED (
  {_matches(0, secrets.ASSIGN, 2, "length(val) >= 8")} UNION ALL {_matches(1, secrets.ACCESS, 0, "true")} UNION ALL {_matches(2, secrets.HEX, 0, "true")}),
mixed AS ({_matches(3, secrets.MIXED, 0, "regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]')")}),
c AS MATERIALIZED (
  SELECT doc_id, source, lang, kind, CAST(stop - length(found) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, val FROM (
    SELECT * FROM base UNION ALL
    SELECT * FROM mixed m WHERE NOT EXISTS (
      SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.stop - length(b.found) < m.stop AND m.stop - length(m.found) < b.stop))),
f AS (SELECT val, count(DISTINCT source) AS owners FROM c GROUP BY val),
k AS (SELECT c.*, owners <= 2 AS live, ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start || ':' || stop AS span
  FROM c JOIN f USING (val) WHERE kind < 3 OR owners <= 2)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""


def _holds(r: quality_rules.Rule) -> str:
    most = f" AND {r.num} <= {r.high!r}::DOUBLE * greatest({r.den}, 1)" if r.high != float("inf") else ""
    return f"({r.num} >= {float(r.low)!r}::DOUBLE * greatest({r.den}, 1){most})"


ORACLES["op1_substring_dedup"] = """
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(35) t(j)),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

ORACLES["op4_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, text, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS plain,
    list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(3) t(j) WHERE k > 1 GROUP BY doc_id),
s AS (
  SELECT w.doc_id, len(words) AS n_words, length(plain) AS word_chars,
    length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, 1 AS one, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bangs,
    len(list_filter(words, lambda x: list_contains({quality_rules.STOP_WORDS!r}, lower(x)))) AS n_stop_words,
    length(regexp_replace(plain, '\\P{{L}}+', '', 'g')) AS n_letters,
    len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '([.][.][.]|…)$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_holds, quality_rules.RULES))} AS kept
FROM b
"""
