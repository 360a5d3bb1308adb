"""Queries of what SQL can state of operators that have no SQL form as a whole: base columns and targets.

Each gets its rows through its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, labels
from sonorant.llm.license_scan import license_scan
from sonorant.llm.pii import op2_pii
from sonorant.llm.quality_rules import BASE, quality_rules
from sonorant.llm.source_mix import source_mix


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir)).select("doc_id", *BASE, "base_failed")


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).drop("spans")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix(documents(spark, sf_dir))
    return mix.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE g.n > 1 GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r USING (doc_id)
"""


def _kind(n: int, name: str, pattern: str, ok: str) -> str:
    """doc_id, kind, s, e of the matches of a pattern that pass a check of m, in code points."""
    return rf"""SELECT doc_id, {n} AS kind, '{name}' AS name, s, s + length(m) AS e FROM (SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
FROM (SELECT doc_id, unnest(range(0, len(ms))) AS k, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)) WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE {ok}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN 2 * CAST(c AS INTEGER) > 9 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
_PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_kind(0, 'email', r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')}
UNION ALL {_kind(1, 'ip', r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', "len(list_filter(string_split(m, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR TRY_CAST(p AS HUGEINT) > 255)) = 0")}
UNION ALL {_kind(2, 'card', r'[0-9](?:[\x20-]?[0-9])+', f'length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}')}
UNION ALL {_kind(3, 'phone', r'\+[0-9][\x20().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 10 AND 15')})
SELECT d.doc_id, {', '.join(f"CAST(count(s.kind) FILTER (s.kind = {k}) AS BIGINT) AS n_{n}" for k, n in enumerate(('email', 'ip', 'card', 'phone')))},
sha256(coalesce(string_agg(name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind), '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def _places(phrase: str) -> str:
    at = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"list_filter(range(0, greatest(len(w) - {len(phrase.split()) - 1}, 0)), lambda i: {at})"


_LICENSE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, {', '.join(f'{_places(x)} AS p{k}' for k, x in enumerate(_PHRASES.values()))} FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p0) + len(p1) + len(p2) AS BIGINT) AS n_base, CAST(list_min(list_concat(p0, p1, p2)) AS BIGINT) AS first_word, CAST(list_max(list_concat(p0, p1, p2)) AS BIGINT) AS last_word,
array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(_PHRASES))}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM p
"""

#: Shares by weight; what goes beyond twice a source's size is shared anew, source by source in order of cap per weight.
_TARGETS = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (SELECT list_sort(list(2.0 * n / weight)) AS ratios, sum(n) * 1.5 AS total FROM s),
c AS (SELECT unnest(ratios) AS ratio, total FROM l),
f AS (SELECT c.ratio, sum(CASE WHEN 2.0 * n / weight < c.ratio THEN 2.0 * n ELSE 0 END) AS capped, sum(CASE WHEN 2.0 * n / weight >= c.ratio THEN weight ELSE 0 END) AS rest, any_value(c.total) AS total FROM c, s GROUP BY c.ratio),
v AS (SELECT max((total - capped) / rest) AS level FROM f WHERE (total - capped) / rest <= ratio)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(s.n AS BIGINT) AS source_size, round(CAST(CASE WHEN level IS NULL OR 2.0 * n / weight < level THEN 2.0 * n ELSE level * weight END AS DOUBLE), 3) AS target, true AS within
FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, v
"""

QUERIES = {f.__name__: f for f in (quality_base_counts, pii_base_spans, license_base_places, mix_targets)}
ORACLES = {"quality_base_counts": _QUALITY, "pii_base_spans": _PII, "license_base_places": _LICENSE, "mix_targets": _TARGETS}
