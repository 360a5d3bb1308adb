"""Queries over words, ranges, paths and levels, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.functions import levels as lv
from sonorant.functions import text as tx
from sonorant.functions.dictionary import Dictionary
from sonorant.operators import match, ranges, tokens
from sonorant.plans.catalogue import EV, RATE, WORD_MS, W, query
from sonorant.plans.catalogue import events as _events
from sonorant.plans.catalogue import table as _table
from sonorant.plans.catalogue import words as _words
from sonorant.sources import wav

#: The dictionary of the queries: the default one hardly ever matches the invented prose of the tables.
ENTRIES = Dictionary((), ()).with_root("tion").with_root("heit").with_root("ment").with_word("the").with_word("und").with_word("que").with_word("of")

# Fixed values, written anew for the SQL side: letters to lower-case, Latin letters that look Cyrillic, the entries' normal forms.
_SQL_UPPER, _SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_SQL_LATIN, _SQL_CYRILLIC = "abcehkmoptxy", "авсенкмортху"
_SQL_ROOTS, _SQL_WORDS = ("тiоn", "неiт", "меnт"), ("тне", "und", "quе", "оf")


def _norm(c: str) -> str:
    """SQL of a word's normal form."""
    letters = f"string_split(regexp_replace(translate(translate({c}, '{_SQL_UPPER}', '{_SQL_LOWER}'), '{_SQL_LATIN}', '{_SQL_CYRILLIC}'), '[^a-zа-яё]', '', 'g'), '')"
    return f"list_reduce({letters}, lambda a, c: CASE WHEN right(a, 1) = c THEN a ELSE a || c END, '')"


def _listed(norm: str) -> str:
    roots = " OR ".join(f"contains({norm}, '{r}')" for r in _SQL_ROOTS)
    return f"({norm} <> '' AND ({roots} OR {norm} IN ({', '.join(repr(w) for w in _SQL_WORDS)})))"


def _merge_sql(source: str, keys: str) -> str:
    """Gaps and islands over rows (keys, s, e)."""
    return f"""
WITH r AS (SELECT * FROM ({source}) WHERE e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT {keys}, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM n GROUP BY {keys}, island
"""


# ---- words and ranges ---------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT text AS word, {_norm('text')} AS norm FROM {W}")
def word_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select(F.col("text").alias("word")).distinct().withColumn("norm", tx.normalise(F.col("word")))


_DOC_WORDS = "(SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)"


def _doc_words(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, w, norm of each document's distinct words; told apart within the row, so nothing shuffles."""
    w = _table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    return w.withColumn("norm", tx.normalise(F.col("w")))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_norm('w')} AS norm FROM {_DOC_WORDS}) WHERE {' OR '.join(f'contains(norm, {r!r})' for r in _SQL_ROOTS)} GROUP BY doc_id")
def dict_semi_join_roots(spark: SparkSession, sf: str) -> DataFrame:
    roots = ENTRIES.table(spark).where("mode = 'substring'")
    return match.semi_join_roots(_doc_words(spark, sf), roots).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {_norm('w')} AS norm FROM {_DOC_WORDS}) WHERE norm IN ({', '.join(repr(w) for w in _SQL_WORDS)}) GROUP BY doc_id")
def dict_semi_join_words(spark: SparkSession, sf: str) -> DataFrame:
    whole = ENTRIES.table(spark).where("mode = 'whole'")
    return match.semi_join_words(_doc_words(spark, sf), whole).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT conv_id, turn, ix, concat(CASE WHEN {_listed('norm')} THEN '  [*] ' ELSE '      ' END, '[', ix * {WORD_MS}, '-', (ix + 1) * {WORD_MS}, ' ms] ', text) AS line "
    f"FROM (SELECT conv_id, turn, ix, text, {_norm('text')} AS norm FROM {W})"
)
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = match.flag(_words(spark, sf), ENTRIES)
    return w.select("conv_id", "turn", F.col("ix").cast("bigint").alias("ix"), tx.flag_line(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("flagged")).alias("line"))


_MARGIN = 41
_TOTAL = f"(max(ix + 1) OVER (PARTITION BY conv_id, turn)) * {WORD_MS * RATE // 1000}"
_PADDING = f"(({_MARGIN} * {RATE}) // 1000)"


@query(_merge_sql(
    f"SELECT conv_id, turn, greatest(0, (ix * {WORD_MS} * {RATE}) // 1000 - {_PADDING}) AS s, least(((ix + 1) * {WORD_MS} * {RATE}) // 1000 + {_PADDING}, total) AS e "
    f"FROM (SELECT *, {_norm('text')} AS norm, {_TOTAL} AS total FROM {W}) WHERE {_listed('norm')}", "conv_id, turn"))  # fmt: skip
def word_ranges_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: listed words of transcripts as merged sample ranges."""
    w = _words(spark, sf)
    size = _table(spark, sf, "conversations").select("conv_id", "turn", (F.size(F.split("text", " ")).cast("bigint") * (WORD_MS * RATE // 1000)).alias("num_samples"))
    w = w.join(size, ["conv_id", "turn"]).withColumn("sample_rate", F.lit(RATE))
    return ranges.from_words(w, ENTRIES, _MARGIN, ("conv_id", "turn"))


_PAD = 1_800_000


@query(_merge_sql(f"SELECT user_id, ms - {_PAD} AS s, ms + {_PAD} AS e FROM {EV}", "user_id"))
def event_ranges_merged(spark: SparkSession, sf: str) -> DataFrame:
    r = _events(spark, sf).select("user_id", (F.col("ms") - _PAD).alias("start"), (F.col("ms") + _PAD).alias("end"))
    return ranges.merge(r, ["user_id"])


@query(_merge_sql(f"SELECT user_id, ms - {_PAD} AS s, ms + {_PAD} AS e FROM {EV} UNION ALL SELECT DISTINCT user_id, 0 AS s, 90000000 AS e FROM events", "user_id"))
def manual_union_ranges(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    manual = e.select("user_id").distinct().select("user_id", F.lit(0).cast("bigint").alias("start"), F.lit(90_000_000).cast("bigint").alias("end"))
    return ranges.union_merge(manual, e.select("user_id", (F.col("ms") - _PAD).alias("start"), (F.col("ms") + _PAD).alias("end")), ["user_id"])


_HOUR = 21_600_000


@query(
    f"WITH c AS (SELECT DISTINCT user_id, (ms // {_HOUR}) * {_HOUR} AS lo, (ms // {_HOUR} + 1) * {_HOUR} AS hi FROM {EV}), r AS (SELECT user_id, event_id, ms AS s, ms + 7200000 AS e FROM {EV}) "
    "SELECT user_id, CAST(lo AS BIGINT) AS lo, count(*) AS n, CAST(sum(least(e, hi) - greatest(s, lo)) AS BIGINT) AS overlap FROM c JOIN r USING (user_id) WHERE s < hi AND e > lo GROUP BY user_id, lo"
)
def overlap_join_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    c = e.select("user_id", (F.floor(F.col("ms") / _HOUR) * _HOUR).alias("lo")).distinct().withColumn("hi", F.col("lo") + _HOUR)
    r = e.select("user_id", "event_id", F.col("ms").alias("start"), (F.col("ms") + 7_200_000).alias("end"))
    pairs = ranges.overlap_join(c, r, ["user_id"], _HOUR)
    return pairs.groupBy("user_id", "lo").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("end", "hi") - F.greatest("start", "lo")).alias("overlap"))


@query(
    f"""
WITH w AS (SELECT conv_id, turn, ix, text FROM {W}),
t AS (SELECT conv_id, turn, ix, 0 AS part, ' ' || substr(text, 1, 3) AS s FROM w UNION ALL SELECT conv_id, turn, ix, 1, substr(text, 4) FROM w WHERE length(text) > 3),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ix, part) - 1 AS n FROM t),
v AS (SELECT *, sum(CASE WHEN s[1] IN (' ', chr(10)) OR n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n ROWS UNBOUNDED PRECEDING) AS word FROM u),
g AS (SELECT conv_id, turn, word, string_agg(regexp_replace(s, '^[ \\n]+', ''), '' ORDER BY n) AS text, min(n) * 200 AS start_ms, max(n) * 200 + 200 AS end_ms, avg((n % 7) / 8.0) AS p FROM v GROUP BY conv_id, turn, word)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY word) - 1 AS INTEGER) AS word_ix, text, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, round(p, 6) AS probability
FROM g WHERE text <> ''
"""
)
def token_to_word(spark: SparkSession, sf: str) -> DataFrame:
    w = _words(spark, sf)
    parts = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit(" "), F.substring("text", 1, 3)).alias("text")), F.struct(F.lit(1).alias("part"), F.expr("substring(text, 4)").alias("text")))
    long_ = F.filter(parts, lambda p: (p["part"] == 0) | (F.length("text") > 3))
    t = w.select("conv_id", "turn", "ix", F.explode(long_).alias("t")).select("conv_id", "turn", "ix", "t.part", "t.text")
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("ix", "part")) - 1
    t = t.withColumn("token_ix", n).withColumns({"segment_ix": F.lit(0), "token_id": F.lit(5), "t0_cs": F.col("token_ix").cast("bigint") * 20, "t1_cs": F.col("token_ix").cast("bigint") * 20 + 20, "p": (F.col("token_ix") % 7) / 8.0})
    out = tokens.to_words(t, 50_257, ("conv_id", "turn"))
    return out.withColumn("probability", F.round("probability", 6))


_SPECS = ("100-250.9", "5-", "-7-9", "x-12", "nodash")


@query("SELECT * FROM (VALUES ('100-250.9', 100, 250), ('5-', 5, 0), ('-7-9', 0, 7), ('x-12', 0, 12), ('nodash', NULL, NULL)) t(spec, start_ms, end_ms)".replace("100, 250)", "CAST(100 AS BIGINT), CAST(250 AS BIGINT))"))
def parse_range_specs(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.createDataFrame([(s,) for s in _SPECS], "spec string").withColumn("r", tx.parse_range(F.col("spec")))
    return r.select("spec", "r.start_ms", "r.end_ms")


@query("SELECT url, regexp_replace(substr(url, 9), '(?i)\\.[^./\\\\]*$', '') || '_clean.wav' AS output FROM pages")
def path_names(spark: SparkSession, sf: str) -> DataFrame:
    """Output names as the WAVE sink gives them to inputs that have their first eight characters in common."""
    return _table(spark, sf, "pages").select("url", wav.output_name(F.col("url"), "https://").alias("output"))


# ---- levels -------------------------------------------------------------------------------------------------------

_X = "(SELECT event_id, value / 100 AS x FROM events)"
_DB = "20 * log10(greatest(abs(x), 1e-12))"


@query(f"SELECT event_id, round({_DB}, 4) AS db, round(pow(10, {_DB} * 0.05), 6) AS gain, round(-0.691 + 10 * log10(x * x + 1e-12), 4) AS lufs FROM {_X}")
def level_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("value") / 100
    db = lv.gain_to_db(F.abs(x))
    return _events(spark, sf).select("event_id", F.round(db, 4).alias("db"), F.round(lv.db_to_gain(db), 6).alias("gain"), F.round(lv.block_loudness(x * x), 4).alias("lufs"))


@query(f"SELECT event_id, CAST(((ms % 1000000) * 44100) // 1000 AS BIGINT) AS at, CAST(greatest(0, least(((ms % 1000000) * 44100) // 1000, 20000000)) AS BIGINT) AS held FROM {EV}")
def sample_positions(spark: SparkSession, sf: str) -> DataFrame:
    at = lv.ms_to_samples(F.col("ms") % 1_000_000, F.lit(44_100))
    return _events(spark, sf).select("event_id", at.alias("at"), lv.clamp_index(at, F.lit(20_000_000).cast("bigint")).alias("held"))
