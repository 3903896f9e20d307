"""The registered queries as SQL over the same tables, where SQL can express them."""

from tablegauge.llm.quality_rules import BASE, BIT, FULL, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_FAIL_BITS = " + ".join(f"CASE WHEN {test} THEN {BIT[name]} ELSE 0 END" for name, test in RULES.items())

LEDGER = rf"""
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM {{docs}}),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT pos) AS n FROM
        (SELECT r, i AS pos FROM twice UNION ALL SELECT r, i + 1 FROM twice UNION ALL SELECT r, i + 2 FROM twice) GROUP BY r),
m AS (SELECT d.r, doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN rep ON rep.r = d.r),
ledger AS (SELECT *, CAST({_FAIL_BITS} AS BIGINT) AS fail_bits FROM m)
"""

QUALITY = f"""WITH {LEDGER.replace('{docs}', 'documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  fail_bits & {BASE.mask} <> 0 AS base_failed, fail_bits & {FULL.mask} = 0 AS kept, fail_bits,
  '{FULL.version}' AS policy_version
FROM ledger"""

SQUEEZED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

EXACT = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, sha256({SQUEEZED}) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)"""

MIX = r"""WITH d AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  sha256(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rk FROM s),
w AS (SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
  CAST(CASE rk % 3 WHEN 0 THEN 1.25 WHEN 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS a,
  CAST(CASE rk % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 ELSE 1.5 END AS DOUBLE) AS b,
  CAST(2 * source_size AS DOUBLE) AS cap FROM r),
v AS (SELECT *, (1.5 * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
l AS (SELECT arg_min(lv, cap / weight * 1e6 + rk) AS lv FROM v WHERE cap / weight >= lv),
t AS (SELECT source, source_size, a, b, least(cap, coalesce(weight * (SELECT lv FROM l), cap)) AS target FROM w),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
f AS (SELECT c.doc_id, c.size, t.source_size, t.target, a, b, c.before,
  least(greatest(floor(target) - before, 0), size) AS one,
  least(greatest(floor(target) - before - source_size, 0), size) AS two
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, least(greatest((before + CASE WHEN one > 0 THEN 0 ELSE source_size END) / target, 0.0), 1.0) AS p FROM f)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one + two > 0 THEN CASE WHEN a = b THEN p ELSE (sqrt(a * a + (b * b - a * a) * p) - a) / (b - a) END END AS first_due
FROM g"""

TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
g AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
i AS (SELECT q, item_id, unnest(list_distinct(t)) AS term
      FROM (SELECT row_number() OVER () AS q, item_id, {TERMS} AS t FROM benchmark)),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM g) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
m AS (SELECT r, doc_id, 50 + (50 * len(t) * (SELECT n FROM g)) // (SELECT l FROM g) AS m FROM d WHERE len(t) > 0),
s AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, item_id, doc_id, r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""

ORACLE = {
    "op4_mix_sources": MIX,
    "op5_quality_rules": QUALITY,
    "op9_exact_dedup": EXACT,
    "op13_lexical_search": RANKED,
}
