"""Queries over signals: every one runs the functions that the pipeline's stages run, on embeddings joined to recordings.

The SQL side is written from the definitions, in doubles, with a cast to REAL where a stage's output is float; values
are compared at five decimals. Recursions over samples or frames are recursive common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.operators import censor, dynamics, loudness, ranges, report, signal, spectral, speech
from sonorant.operators.filters import Biquad, filtered, high_pass
from sonorant.plans.catalogue import chunks, query, samples_sql, table
from sonorant.plans.options import PipelineOptions
from sonorant.plans.pipeline import run
from sonorant.sources import wav
from sonorant.sources.ranges import manual_ranges
from sonorant.streaming import chain

K = 16  # embeddings of a recording
S = samples_sql(K)
LIMIT = f"(SELECT vec_id // {K} AS a, count(*) * 64 AS n FROM embeddings GROUP BY 1)"


def _real(x: str) -> str:
    return f"CAST(CAST({x} AS REAL) AS DOUBLE)"


def _ID(x: str = "a") -> str:  # noqa: N802
    return f"CAST({x} AS VARCHAR) AS asset_id"


def _values(df: DataFrame, name: str = "value") -> DataFrame:
    """asset_id, sample_ix and the rounded value of chunk rows."""
    return signal.exploded(df).select("asset_id", "sample_ix", (F.round(F.col("value").cast("double"), 5) + 0.0).alias(name))


def _out(source: str, value: str = "v", name: str = "value") -> str:
    return f"SELECT {_ID()}, CAST(i AS BIGINT) AS sample_ix, round({value}, 5) + 0.0 AS {name} FROM {source}"


# ---- samples ------------------------------------------------------------------------------------------------------


@query(_out(S, "x"))
def wav_round_trip_float(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings as 32-bit files, parsed and decoded again."""
    return _values(wav.decoded(_files(spark, sf, 32), 100))


_SCALED = "CAST(greatest(-1, least(1, x)) AS REAL) * CAST(32767 AS REAL)"


@query(_out(f"(SELECT a, i, {_real(f'sign({_SCALED}) * floor(abs({_SCALED}) + CAST(0.5 AS REAL)) / 32768.0')} AS v FROM {S})"))
def wav_round_trip_int(spark: SparkSession, sf: str) -> DataFrame:
    return _values(wav.decoded(_files(spark, sf, 16), 100))


@query(f"SELECT {_ID()}, bits, 8000 AS sample_rate, 1 AS channels, CAST(n AS BIGINT) AS num_samples, bits = 32 AS is_float, CAST(NULL AS VARCHAR) AS error FROM {LIMIT}, (SELECT unnest([16, 32]) AS bits)")
def wav_headers(spark: SparkSession, sf: str) -> DataFrame:
    both = wav.described(_files(spark, sf, 16)).unionByName(wav.described(_files(spark, sf, 32)))
    return both.select("asset_id", "bits", "sample_rate", "channels", "num_samples", "is_float", "error")


def _files(spark: SparkSession, sf: str, bits: int) -> DataFrame:
    """path, content: recordings as the WAVE sink encodes them, pieces put together."""
    c = chunks(spark, sf, K)
    assets = c.groupBy("asset_id").agg(F.lit(8000).alias("sample_rate"), F.lit(1).alias("channels"), F.sum(F.size("samples")).cast("bigint").alias("num_samples"))
    pieces = wav.encoded(c, assets, bits).groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("part_ix", "content"))).alias("p"))
    return pieces.select(F.col("asset_id").alias("path"), F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.content))").alias("content"))


@query("SELECT vec_id, round(CASE WHEN p > 0 THEN 20 * log10(p) ELSE -100 END, 4) AS true_peak_db FROM (SELECT vec_id, CAST(list_max(list_transform(embedding, lambda x: abs(x))) AS DOUBLE) AS p FROM embeddings)")
def true_peak_db(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("samples"))
    return signal.true_peak(c).select(F.col("asset_id").alias("vec_id"), F.round("true_peak_db", 4).alias("true_peak_db"))


@query(f"SELECT {_ID()}, CAST(i AS BIGINT) AS sample_ix, round({_real('avg(x)')}, 5) + 0.0 AS value FROM (SELECT vec_id // 4 AS a, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY a, i")
def mixdown(spark: SparkSession, sf: str) -> DataFrame:
    """Four embeddings as the channels of a recording."""
    c = chunks(spark, sf, 4).withColumns({"channel": F.col("chunk_ix"), "chunk_ix": F.lit(0), "start_sample": F.lit(0).cast("bigint")})
    return _values(signal.mixdown_chunks(c))


@query(f"SELECT {_ID()}, CAST(i AS BIGINT) AS sample_ix, round({_real('x')} * CAST(0.5 + (i % 64 % 4) / 8.0 AS DOUBLE), 5) + 0.0 AS value FROM {S} WHERE i % 64 < 40")
def envelope_multiply(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: 0.5 + (i % 4) / 8.0)
    return _values(chunks(spark, sf, K).withColumn("samples", signal.multiplied(F.transform("samples", lambda x: x.cast("double")), e)))


@query(f"SELECT {_ID()}, CAST(n AS BIGINT) AS num_samples, CAST(least(n, 2 * 8) AS BIGINT) AS censored FROM {LIMIT}")
def manual_range_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Manual ranges of every recording, merged and clamped: 1-2 ms and an inverted one, at 16 kHz."""
    sized = chunks(spark, sf, K).groupBy("asset_id").agg(F.lit(16_000).alias("sample_rate"), F.sum(F.size("samples")).cast("bigint").alias("num_samples"))
    found = ranges.merge(manual_ranges(sized, ["1-2", "9-3", "x"]).join(sized.select("asset_id", "num_samples"), "asset_id"), ["asset_id"], total="num_samples")
    return sized.join(found, "asset_id").groupBy("asset_id").agg(F.first("num_samples").alias("num_samples"), F.sum(F.col("end") - F.col("start")).alias("censored"))


# ---- loudness -----------------------------------------------------------------------------------------------------

_HOP, _BLOCK = 30, 118  # a block that is no multiple of the hop, as at 11,025 Hz


def _blocks_sql(source: str, hop: int, block: int) -> str:
    """b: a, block, mean_square of the complete blocks of a source (a, i, v)."""
    return f"""b AS (SELECT h.a, h.block, sum(s.v * s.v) / {block} AS mean_square FROM (SELECT DISTINCT a, i // {hop} AS block FROM {source}) h
JOIN {source} s ON s.a = h.a AND s.i >= h.block * {hop} AND s.i < h.block * {hop} + {block} GROUP BY h.a, h.block HAVING count(*) = {block})"""


def _gate_sql(name: str = "g") -> str:
    """{name}: a, lufs, from b; what has no block is missing."""
    return f"""{name} AS (SELECT a, coalesce(-0.691 + 10 * log10(avg(CASE WHEN l >= -70 AND l >= least_ THEN mean_square END)), -100) AS lufs
FROM (SELECT *, -0.691 + 10 * log10(avg(CASE WHEN l >= -70 THEN mean_square END) OVER (PARTITION BY a)) - 10 AS least_ FROM (SELECT *, -0.691 + 10 * log10(mean_square + 1e-12) AS l FROM b)) GROUP BY a)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return loudness.blocks(loudness.chunk_hop_sums(chunks(spark, sf, K), _HOP, _BLOCK), _HOP, _BLOCK)


@query(f"WITH s AS (SELECT a, i, x AS v FROM {S}), {_blocks_sql('s', _HOP, _BLOCK)} SELECT {_ID()}, CAST(block AS BIGINT) AS block, round(mean_square, 7) AS mean_square FROM b")
def block_mean_square(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("asset_id", "block", F.round("mean_square", 7).alias("mean_square"))


@query(f"WITH s AS (SELECT a, i, x AS v FROM {S}), {_blocks_sql('s', _HOP, _BLOCK)}, {_gate_sql()} SELECT {_ID()}, round(lufs, 4) AS lufs, round(greatest(-24, least(24, -16 - lufs)), 4) AS gain_db FROM g")
def gated_loudness(spark: SparkSession, sf: str) -> DataFrame:
    g = loudness.gated(_blocks(spark, sf))
    return g.select("asset_id", F.round("lufs", 4).alias("lufs"), F.round(loudness.mastering_gain_db(F.col("lufs")), 4).alias("gain_db"))


# Fixed values of the loudness standard, written anew for the SQL side: the two K-weighting stages.
_SHELF_HZ, _SHELF_Q, _SHELF_DB, _SHELF_POWER = 1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416
_CUT_HZ, _CUT_Q = 38.13547087602444, 0.5003270373238773


def _k_design(rate: str) -> str:
    """One row of both stages' coefficients at a rate."""
    return f"""SELECT *, (v + b * k / q + k * k) / n AS p0, 2 * (k * k - v) / n AS p1, (v - b * k / q + k * k) / n AS p2, 2 * (k * k - 1) / n AS r1, (1 - k / q + k * k) / n AS r2,
1 / m AS u0, -2 / m AS u1, 1 / m AS u2, 2 * (j * j - 1) / m AS w1, (1 - j / {_CUT_Q} + j * j) / m AS w2 FROM (SELECT *, pow(v, {_SHELF_POWER}) AS b, 1 + k / q + k * k AS n, 1 + j / {_CUT_Q} + j * j AS m
FROM (SELECT {rate} AS rate, tan(pi() * {_SHELF_HZ} / {rate}) AS k, pow(10, {_SHELF_DB} / 20) AS v, {_SHELF_Q} AS q, tan(pi() * {_CUT_HZ} / {rate}) AS j))"""


_RATES = (11_025, 16_000, 44_100, 48_000)


@query(" UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS rate, round(p0, 8) AS shelf_b0, round(r1, 8) AS shelf_a1, round(u0, 8) AS cut_b0, round(w2, 8) AS cut_a2 FROM ({_k_design(f'{r}.0')})" for r in _RATES))
def k_weighting_design(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(r, round(loudness.high_shelf(r).b0, 8), round(loudness.high_shelf(r).a1, 8), round(loudness.low_cut(r).b0, 8), round(loudness.low_cut(r).a2, 8)) for r in _RATES]
    return spark.createDataFrame(rows, "rate int, shelf_b0 double, shelf_a1 double, cut_b0 double, cut_a2 double")


def _weighted_sql(source: str, name: str, rate: float) -> str:
    """{name}: a, i, v: a source (a, i, v) after both stages, each rounded to float."""
    step = f"""SELECT a, i, {_real('y2')} AS v, c1, c2, d1, d2 FROM (SELECT a, i, u0 * t + d1_ AS y2, c1, c2, u1 * t - w1 * (u0 * t + d1_) + d2_ AS d1, u2 * t - w2 * (u0 * t + d1_) AS d2
FROM (SELECT a, i, {_real('y1')} AS t, p1 * x - r1 * y1 + c2_ AS c1, p2 * x - r2 * y1 AS c2, d1_, d2_, u0, u1, u2, w1, w2 FROM (SELECT *, p0 * x + c1_ AS y1 FROM (%s))))"""
    first = f"SELECT s.a, s.i, s.v AS x, 0.0::DOUBLE AS c1_, 0.0::DOUBLE AS c2_, 0.0::DOUBLE AS d1_, 0.0::DOUBLE AS d2_, k.* FROM {source} s, design k WHERE s.i = 0"
    then = f"SELECT s.a, s.i, s.v AS x, c.c1 AS c1_, c.c2 AS c2_, c.d1 AS d1_, c.d2 AS d2_, k.* FROM {name} c JOIN {source} s ON s.a = c.a AND s.i = c.i + 1, design k"
    return f"{name} AS ({step % first} UNION ALL {step % then})"


_LOUD_K, _LOUD_RATE = 40, 4000.0
_LOUD_DESIGN = f"design AS ({_k_design(str(_LOUD_RATE))})"


@query(
    f"WITH RECURSIVE {_LOUD_DESIGN}, s AS (SELECT a, i, x AS v FROM {samples_sql(_LOUD_K)}), {_weighted_sql('s', 'kw', _LOUD_RATE)}, {_blocks_sql('kw', 400, 1600)}, {_gate_sql()} "
    f"SELECT {_ID('l.a')}, round(coalesce(lufs, -100), 4) AS lufs FROM (SELECT DISTINCT vec_id // {_LOUD_K} AS a FROM embeddings) l LEFT JOIN g ON g.a = l.a"
)
def integrated_loudness(spark: SparkSession, sf: str) -> DataFrame:
    return loudness.integrated(chunks(spark, sf, _LOUD_K), _LOUD_RATE).select("asset_id", F.round("lufs", 4).alias("lufs"))


# ---- filters and dynamics -------------------------------------------------------------------------------------------


def _high_pass_sql(rate: float, cutoff: float = 80.0) -> str:
    """b0, b1, b2, a1, a2 of the cookbook's high-pass, as floats."""
    parts = {"b0": "(1 + c) * 0.5 / a0", "b1": "-(1 + c) / a0", "b2": "(1 + c) * 0.5 / a0", "a1": "-2 * c / a0", "a2": "(1 - al) / a0"}
    return f"SELECT {', '.join(f'{_real(x)} AS {n}' for n, x in parts.items())} FROM (SELECT *, 1 + al AS a0 FROM (SELECT cos(w) AS c, sin(w) / (2 * sqrt(0.5::DOUBLE)) AS al FROM (SELECT 2 * pi() * {cutoff} / {rate} AS w)))"


@query(
    f"""
WITH RECURSIVE s AS {S}, h AS ({_high_pass_sql(1000.0)}),
y AS (SELECT a, i, b0 * x AS y, b1 * x - a1 * b0 * x AS z1, b2 * x - a2 * b0 * x AS z2 FROM s, h WHERE i = 0
UNION ALL SELECT s.a, s.i, b0 * x + z1, b1 * x - a1 * (b0 * x + z1) + z2, b2 * x - a2 * (b0 * x + z1) FROM y JOIN s ON s.a = y.a AND s.i = y.i + 1, h)
{_out('y', _real('y'))}
"""
)
def high_pass_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _values(filtered(chunks(spark, sf, K), lambda: [Biquad(high_pass(1000.0, 80.0))]))


_AHEAD = 5
_LIMITED = f"""p AS (SELECT a, i, x, max(abs(x)) OVER (PARTITION BY a ORDER BY i ROWS BETWEEN CURRENT ROW AND {_AHEAD} FOLLOWING) AS peak FROM s),
d AS (SELECT a, i, x, CASE WHEN peak > 0.1 THEN 0.1 / peak ELSE 1.0::DOUBLE END AS d FROM p), r AS (SELECT 1 - exp(-1 / 4.0) AS r),
c AS (SELECT a, i, x, least(d, (1 - r) + r * d) AS g FROM d, r WHERE i = 0 UNION ALL SELECT d.a, d.i, d.x, least(d.d, (1 - r) * c.g + r * d.d) FROM c JOIN d ON d.a = c.a AND d.i = c.i + 1, r)"""


def _limited(spark: SparkSession, sf: str) -> DataFrame:
    return dynamics.limited(chunks(spark, sf, K), 1000.0, ceiling_db=-20.0, ahead_ms=5.0, release_ms=4.0)


@query(f"WITH RECURSIVE s AS {S}, {_LIMITED} {_out('c', _real('x * g'))}")
def limiter_apply(spark: SparkSession, sf: str) -> DataFrame:
    return _values(_limited(spark, sf))


@query(f"WITH RECURSIVE s AS {S}, {_LIMITED} SELECT {_ID()}, round(20 * log10(greatest({_real('min(g)')}, 1e-12)), 4) AS reduction_db FROM c GROUP BY a")
def limiter_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return dynamics.reduction_db(_limited(spark, sf)).select("asset_id", F.round("limiter_reduction_db", 4).alias("reduction_db"))


# ---- censor -------------------------------------------------------------------------------------------------------

_CENSOR_RATE = 1000.0  # a fade of 5 ms is 5 samples
_RANGES = f"(SELECT a, 4 + a % 5 AS s, 130 + a % 11 AS e FROM {LIMIT} UNION ALL SELECT a, 150 AS s, 150 + a % 4 AS e FROM {LIMIT} WHERE a % 4 > 0)"


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges over two chunk borders, and short ones."""
    v = chunks(spark, sf, K).select("asset_id").distinct().withColumn("a", F.col("asset_id").cast("bigint"))
    one = v.select("asset_id", (4 + F.col("a") % 5).alias("start"), (130 + F.col("a") % 11).alias("end"))
    return one.unionByName(v.where("a % 4 > 0").select("asset_id", F.lit(150).cast("bigint").alias("start"), (150 + F.col("a") % 4).alias("end")))


def _censor_sql(wet: str) -> str:
    return f"""
WITH r AS (SELECT a, s, e, least(5, (e - s) // 2) AS fade FROM {_RANGES}),
j AS (SELECT p.a, p.i, p.x, r.s, r.e, r.fade, sqrt(avg(p.x * p.x) OVER (PARTITION BY p.a, r.s)) AS rms FROM {S} p LEFT JOIN r ON r.a = p.a AND r.s <= p.i AND p.i < r.e),
k AS (SELECT *, CASE WHEN fade > 0 AND i - s < fade THEN (i - s) / fade WHEN fade > 0 AND e - i <= fade THEN (e - i) / fade ELSE 1.0 END::DOUBLE AS env FROM j)
{_out('k', f"CASE WHEN s IS NULL THEN x ELSE {_real(f'x * (1 - env) + ({wet}) * env')} END")}
"""


def _censored(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return _values(censor.censored(chunks(spark, sf, K), _ranges(spark, sf), _CENSOR_RATE, mode, hz=125.0, width=100))


@query(_censor_sql("0.0"))
def censor_mute(spark: SparkSession, sf: str) -> DataFrame:
    return _censored(spark, sf, "mute")


@query(_censor_sql("least(0.95, greatest(0.05, 2 * rms)) * sin(2 * pi() * 125 / 1000 * (i - s))"))
def censor_beep(spark: SparkSession, sf: str) -> DataFrame:
    return _censored(spark, sf, "beep")


# ---- spectra ------------------------------------------------------------------------------------------------------

ORDER, POINTS, HOP, BINS = 6, 64, 16, 33
_STFT = spectral.Stft(ORDER, POINTS // HOP)
_FRAMES = f"""s AS {S}, n AS {LIMIT}, w AS (SELECT k, {_real(f'0.5 * (1 - cos(2 * pi() * k / {POINTS}))')} AS w FROM (SELECT unnest(range(0, {POINTS})) AS k)),
t AS (SELECT j, cos(2 * pi() * j / {POINTS}) AS c, sin(2 * pi() * j / {POINTS}) AS s FROM (SELECT unnest(range(0, {POINTS})) AS j)), bins AS (SELECT unnest(range(0, {BINS})) AS b),
f AS (SELECT a, n, unnest(range(0, CAST(1 + ceil(n / {HOP}.0) AS BIGINT))) AS f FROM n),
y AS (SELECT f.a, f.f, k, x * w AS y FROM f, w JOIN s ON s.a = f.a AND s.i = f.f * {HOP} - {POINTS // 2} + k),
d AS (SELECT a, f, b, sum(y * t.c) AS re, -sum(y * t.s) AS im FROM y, bins JOIN t ON t.j = (b * k) % {POINTS} GROUP BY a, f, b)"""


@query(f"WITH {_FRAMES} SELECT CAST(k AS INTEGER) AS i, round(w, 6) AS w FROM w")
def hann_window(spark: SparkSession, sf: str) -> DataFrame:
    """The window that the stages use."""
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(_STFT.window)], "i int, w double").select("i", F.round("w", 6).alias("w"))


@query(f"WITH {_FRAMES} SELECT {_ID()}, CAST(f AS INTEGER) AS frame_ix, CAST(b AS INTEGER) AS bin, round({_real('re')}, 4) + 0.0 AS re, round({_real('im')}, 4) + 0.0 AS im FROM d WHERE a % 4 = 0")
def spectral_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Half spectra of a quarter of the recordings (the oracle's rows are many)."""
    z = spectral.frames(chunks(spark, sf, K).where("asset_id % 4 = 0"), _STFT).select("asset_id", "frame_ix", F.posexplode(F.arrays_zip("real", "imag")).alias("bin", "z"))
    return z.select("asset_id", "frame_ix", "bin", (F.round(F.col("z.real").cast("double"), 4) + 0.0).alias("re"), (F.round(F.col("z.imag").cast("double"), 4) + 0.0).alias("im"))


@query(f"WITH {_FRAMES} SELECT {_ID()}, CAST(f AS INTEGER) AS frame_ix, CAST(b AS INTEGER) AS bin, round({_real('sqrt(re * re + im * im)')}, 4) AS magnitude FROM d")
def spectral_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    z = spectral.frames(chunks(spark, sf, K), _STFT, magnitudes=True).select("asset_id", "frame_ix", F.posexplode("magnitude").alias("bin", "m"))
    return z.select("asset_id", "frame_ix", "bin", F.round(F.col("m").cast("double"), 4).alias("magnitude"))


@query(_out(S, "x"))
def stft_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Framing, window, transform, overlap-add and normalisation give the signal back."""
    return _values(spectral.transformed(chunks(spark, sf, K), _STFT, lambda: lambda spectra: spectra))


_TAPS, _IN, _TO = 32, 44_100.0, 16_000.0
_RATIO = f"(CAST({_TO} AS DOUBLE) / CAST({_IN} AS DOUBLE))"


@query(
    f"""WITH s AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
o AS (SELECT o, o / {_RATIO} AS place FROM (SELECT unnest(range(0, CAST(floor(64 * {_RATIO} + 0.5) AS BIGINT))) AS o)),
k AS (SELECT o, place, unnest(range({1 - _TAPS // 2}, {_TAPS // 2 + 1})) AS k FROM o),
t AS (SELECT o, CAST(floor(place) AS BIGINT) + k AS i, k - (place - floor(place)) AS u FROM k),
w AS (SELECT o, i, (CASE WHEN u = 0 THEN 1.0 ELSE sin(pi() * u * {_RATIO}) / (pi() * u * {_RATIO}) END) * 0.5 * (1 + cos(pi() * u / {_TAPS // 2})) AS w FROM t WHERE i >= 0 AND i < 64)
SELECT vec_id, CAST(o AS INTEGER) AS i, round({_real('sum(x * w) / sum(w)')}, 5) + 0.0 AS value FROM w JOIN s USING (i) GROUP BY vec_id, o"""
)
def resample_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = spectral.resampled(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples")), _IN, _TO, _TAPS)
    return out.select("vec_id", F.posexplode("samples").alias("i", "v")).select("vec_id", "i", (F.round(F.col("v").cast("double"), 5) + 0.0).alias("value"))


# ---- speech -------------------------------------------------------------------------------------------------------


def _activity_sql(power: str) -> str:
    """m: the powers of a frame as a list; v: the recursion over frames with speech probability, noise and Wiener gain.

    The row before the first frame has frame -1 and only the gains and powers that the first frame starts from.
    """
    zip2 = "list_transform(list_zip({}, {}), lambda z: {})".format
    p = "least(1, greatest(0, (0.35 + 0.65 * least(1, greatest(0, (0.7 - flat) / 0.5))) / (1 + exp(-(snr - 6) / 4))))"
    flat = "exp(list_avg(list_transform(pw, lambda z: ln(z + 1e-12)))) / (list_avg(pw) + 1e-12)"
    snr = "10 * log10((list_sum(pw) + 1e-12) / (list_sum(n2) + 1e-12))"
    return f"""m AS (SELECT a, f, list({power} ORDER BY b) AS pw FROM d GROUP BY a, f),
v AS (SELECT DISTINCT a, CAST(-1 AS BIGINT) AS f, CAST([] AS DOUBLE[]) AS smooth, CAST([] AS DOUBLE[]) AS lo, CAST([] AS DOUBLE[]) AS before, 0 AS cnt, CAST([] AS DOUBLE[]) AS n2, CAST(0 AS DOUBLE) AS p,
list_transform(range(0, {BINS}), lambda z: CAST(1 AS DOUBLE)) AS g, list_transform(range(0, {BINS}), lambda z: CAST(0 AS DOUBLE)) AS pp FROM m
UNION ALL
SELECT a, f, smooth, lo, before, cnt, n2, p, list_transform(list_zip(g, g1, list_transform(g1, lambda z, k: 0.25 * g1[greatest(k - 1, 1)] + 0.5 * z + 0.25 * g1[least(k + 1, {BINS})])), lambda z: least(1, greatest(0.6 * z[1] + 0.4 * z[3], pow(10, -0.6)))) AS g, pw AS pp
FROM (SELECT *, list_transform(list_zip(g0, post), lambda z: z[1] + (1 - z[1]) * 0.9 * p * z[2] / (z[2] + 1)) AS g1
FROM (SELECT *, list_transform(list_zip(g, pp, noise, post), lambda z: (0.98 * z[1] * z[1] * z[2] / z[3] + 0.02 * greatest(z[4] - 1, 0)) / (0.98 * z[1] * z[1] * z[2] / z[3] + 0.02 * greatest(z[4] - 1, 0) + 1)) AS g0
FROM (SELECT *, {zip2('pw', 'noise', 'z[1] / z[2]')} AS post FROM (SELECT *, list_transform(n2, lambda z: greatest(z, 1e-12)) AS noise
FROM (SELECT a, f, pw, p, g, pp, smooth, lo, before, cnt, {zip2('lo', 'before', '5 * greatest(least(z[1], z[2]), 1e-9)')} AS n2
FROM (SELECT a, f, pw, p, g, pp, smooth, CASE WHEN full_ THEN smooth ELSE lo END AS lo, CASE WHEN full_ THEN lo ELSE before END AS before, CASE WHEN full_ THEN 0 ELSE cnt END AS cnt
FROM (SELECT a, f, pw, p, g, pp, smooth, lo, before, cnt, cnt >= 48 AND f > 0 AND p < 0.5 AS full_
FROM (SELECT a, f, pw, p, g, pp, smooth, CASE WHEN f = 0 THEN h WHEN p < 0.5 THEN {zip2('lo', 'smooth', 'least(z[1], z[2])')} ELSE lo END AS lo, CASE WHEN f = 0 THEN h ELSE before END AS before, CASE WHEN f > 0 AND p < 0.5 THEN cnt + 1 ELSE cnt END AS cnt
FROM (SELECT a, f, pw, h, p, g, pp, lo, before, cnt, CASE WHEN f = 0 THEN h WHEN p < 0.5 THEN {zip2('smooth', 'h', 'z[1] + 0.5 * (z[2] - z[1])')} ELSE smooth END AS smooth
FROM (SELECT *, CASE WHEN f = 0 THEN 0 ELSE {p} END AS p
FROM (SELECT v.a, m.f, m.pw, list_transform(m.pw, lambda z: greatest(z, 1e-9)) AS h, v.smooth, v.lo, v.before, v.cnt, v.g, v.pp, {flat} AS flat, CASE WHEN v.f < 0 THEN 0 ELSE {snr} END AS snr FROM v JOIN m ON m.a = v.a AND m.f = v.f + 1)))))))))))
)"""


_POWER = "re * re + im * im"
_FLOAT_POWER = f"pow({_real('sqrt(re * re + im * im)')}, 2)"


@query(f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_FLOAT_POWER)} SELECT {_ID()}, CAST(f AS INTEGER) AS frame_ix, round({_real('p')}, 5) AS probability, round({_real('sqrt(n2[5])')}, 5) AS noise FROM v WHERE f >= 0")
def voice_activity(spark: SparkSession, sf: str) -> DataFrame:
    v = speech.voice_activity(spectral.frames(chunks(spark, sf, K), _STFT, magnitudes=True))
    return v.select("asset_id", "frame_ix", F.round(F.col("probability").cast("double"), 5).alias("probability"), F.round(F.get("noise_magnitude", F.lit(4)).cast("double"), 5).alias("noise"))


_DENOISED = f"""x AS (SELECT v.a, v.f, unnest(range(0, {BINS})) AS b, unnest(g) AS g FROM v WHERE f >= 0),
z AS (SELECT x.a, x.f, k, sum(CASE WHEN b IN (0, {BINS - 1}) THEN 1 ELSE 2 END * g * (re * t.c - im * t.s)) / {POINTS} AS z FROM x JOIN d USING (a, f, b), (SELECT unnest(range(0, {POINTS})) AS k) JOIN t ON t.j = (b * k) % {POINTS} GROUP BY x.a, x.f, k),
o AS (SELECT z.a, z.f * {HOP} - {POINTS // 2} + k AS i, sum(z * w) AS num, sum(w * w) AS den FROM z JOIN w USING (k) GROUP BY 1, 2),
e AS (SELECT o.a, i, {_real('CASE WHEN den > 1e-8 THEN num / den ELSE num END')} AS v FROM o JOIN n ON n.a = o.a WHERE i >= 0 AND i < n)"""


def _denoised(spark: SparkSession, sf: str) -> DataFrame:
    return speech.denoised(chunks(spark, sf, K), speech.DenoiseSettings(order=ORDER))


@query(f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_POWER)}, {_DENOISED} {_out('e')}")
def denoise(spark: SparkSession, sf: str) -> DataFrame:
    return _values(_denoised(spark, sf))


@query(f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_POWER)} SELECT {_ID()}, round(avg(CASE WHEN p < 0.35 THEN 1.0 ELSE 0.0 END), 6) AS non_speech_ratio, CAST(1 AS INTEGER) AS denoised_channels FROM v WHERE f >= 0 GROUP BY a")
def non_speech_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return speech.non_speech_ratio(_denoised(spark, sf)).select("asset_id", F.round("non_speech_ratio", 6).alias("non_speech_ratio"), "denoised_channels")


_GATE_RATE, _HELD = 1000.0, 9  # 150 ms of frames of 16 samples, rounded
_GATED = f"""q AS (SELECT DISTINCT a, CAST(-1 AS BIGINT) AS f, 0 AS held, false AS opened, CAST(0.001 AS DOUBLE) AS level FROM v
UNION ALL SELECT a, f, CASE WHEN opened THEN held - 1 ELSE held END, opened, level + (CASE WHEN target > level THEN 1 - exp(-0.016 / 0.03) ELSE 1 - exp(-0.016 / 0.15) END) * (target - level)
FROM (SELECT *, held > 0 AS opened, CASE WHEN held > 0 THEN 1.0 ELSE 0.001 END::DOUBLE AS target FROM (SELECT q.a, v.f, q.level, CASE WHEN v.p >= 0.35 THEN {_HELD} ELSE q.held END AS held FROM q JOIN v ON v.a = q.a AND v.f = q.f + 1))),
u AS (SELECT a, f, level, coalesce(lead(level) OVER (PARTITION BY a ORDER BY f), level) AS next FROM q WHERE f >= 0),
e AS (SELECT s.a, s.i, s.x, {_real(f'level + (next - level) * (s.i - u.f * {HOP}) / {HOP}.0')} AS gain FROM s JOIN u ON u.a = s.a AND u.f = s.i // {HOP})"""


def _gate(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return speech.silenced(chunks(spark, sf, K), _GATE_RATE, speech.GateSettings(order=ORDER))


@query(f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_POWER)}, {_GATED} {_out('e', 'gain', 'gain')}")
def gate_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _values(_gate(spark, sf)[1], "gain")


@query(f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_POWER)}, {_GATED} {_out('e', _real('CAST(x AS REAL) * CAST(gain AS REAL)'))}")
def silence_non_speech(spark: SparkSession, sf: str) -> DataFrame:
    return _values(_gate(spark, sf)[0])


@query(
    f"WITH RECURSIVE {_FRAMES}, {_activity_sql(_POWER)}, {_GATED} SELECT {_ID()}, round(silenced, 6) AS silenced_ratio, round(opened, 6) AS speech_ratio FROM (SELECT a, avg(CASE WHEN gain < 0.5 THEN 1.0 ELSE 0.0 END) AS silenced FROM e GROUP BY a) "
    "JOIN (SELECT a, avg(CASE WHEN opened THEN 1.0 ELSE 0.0 END) AS opened FROM q WHERE f >= 0 GROUP BY a) USING (a)"
)
def silenced_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return speech.silenced_ratio(_gate(spark, sf)[1]).select("asset_id", F.round("silenced_ratio", 6).alias("silenced_ratio"), F.round("speech_ratio", 6).alias("speech_ratio"))


# ---- streaming chain ------------------------------------------------------------------------------------------------


def _peaking_sql(hz: float, q: float, db: float, rate: float) -> str:
    return (
        f"SELECT (1 + al * g) / a0 AS b0, -2 * c / a0 AS b1, (1 - al * g) / a0 AS b2, -2 * c / a0 AS a1, (1 - al / g) / a0 AS a2 FROM (SELECT *, 1 + al / g AS a0 "
        f"FROM (SELECT cos(w) AS c, sin(w) / (2 * {q}) AS al, pow(10, {db} / 40.0) AS g FROM (SELECT 2 * pi() * {hz} / {rate} AS w)))"
    )


_CHAIN_RATE = 48_000.0
_CHAIN = chain.ChainSettings(gate_threshold_db=-20.0, ratio=4.0, output_gain_db=3.0)
_COEFFICIENT = {n: f"exp(-1 / ({ms} * 0.001 * {_CHAIN_RATE}))" for n, ms in {"ga": 3.0, "gr": 150.0, "ca": 10.0, "cr": 100.0}.items()}
_FILTERS = f"h AS ({_high_pass_sql(_CHAIN_RATE)}), e1 AS ({_peaking_sql(300.0, 0.8, -3.0, _CHAIN_RATE)}), e2 AS ({_peaking_sql(3000.0, 0.8, 2.0, _CHAIN_RATE)})"


def _filter_sql(name: str, source: str, f: str) -> str:
    """{name}: a, ch, i, v: a source (a, ch, i, v) after the filter f, rounded to float."""
    return f"""{name} AS (SELECT a, ch, i, {_real('b0 * v')} AS v, b1 * v - a1 * b0 * v AS z1, b2 * v - a2 * b0 * v AS z2 FROM {source}, {f} WHERE i = 0
UNION ALL SELECT s.a, s.ch, s.i, {_real('b0 * s.v + c.z1')}, b1 * s.v - a1 * (b0 * s.v + c.z1) + c.z2, b2 * s.v - a2 * (b0 * s.v + c.z1) FROM {name} c JOIN {source} s ON s.a = c.a AND s.ch = c.ch AND s.i = c.i + 1, {f})"""


_CHAIN_SQL = f"""
WITH RECURSIVE {_FILTERS}, r AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _COEFFICIENT.items())}),
s AS (SELECT a, 0 AS ch, i, x AS v FROM {S} UNION ALL SELECT a, 1 AS ch, i, {_real('x * 0.5')} AS v FROM {S}), {_filter_sql('hp', 's', 'h')},
l AS (SELECT a, i, max(abs(v)) AS x FROM hp GROUP BY a, i),
y AS (SELECT DISTINCT a, CAST(-1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS env, CAST(1 AS DOUBLE) AS gate, CAST(0 AS DOUBLE) AS comp FROM l
UNION ALL SELECT a, i, env, gate, k * comp + (1 - k) * y FROM (SELECT *, CASE WHEN y > comp THEN ca ELSE cr END AS k FROM (SELECT *, x * gate AS y
FROM (SELECT a, i, x, env, comp, ca, cr, k * gate + (1 - k) * target AS gate FROM (SELECT *, CASE WHEN target > gate THEN ga ELSE gr END AS k FROM (SELECT *, CASE WHEN env >= 0.1 THEN 1 ELSE 0 END AS target
FROM (SELECT a, i, x, gate, comp, ga, gr, ca, cr, k * env + (1 - k) * x AS env FROM (SELECT l.a, l.i, l.x, y.env, y.gate, y.comp, r.*, CASE WHEN l.x > y.env THEN ga ELSE gr END AS k FROM y JOIN l ON l.a = y.a AND l.i = y.i + 1, r)))))))),
g AS (SELECT a, i, gate * (CASE WHEN comp > 0 AND 20 * log10(comp) > -18 THEN pow(10, (20 * log10(comp) + 18) * (1 / 4.0 - 1) * 0.05) ELSE 1 END) AS g FROM y WHERE i >= 0),
gated AS (SELECT a, ch, i, hp.v * g.g AS v FROM hp JOIN g USING (a, i)), {_filter_sql('q1', 'gated', 'e1')}, {_filter_sql('q2', 'q1', 'e2')},
out_ AS (SELECT a, ch, i, {_real('greatest(-pow(10, -0.05), least(pow(10, -0.05), v * pow(10, 0.15)))')} AS v FROM q2)
SELECT CAST(a AS VARCHAR) AS stream_id, CAST(ch AS INTEGER) AS channel, CAST(i AS BIGINT) AS sample_ix, round(v, 5) + 0.0 AS value FROM out_
"""


@query(_CHAIN_SQL)
def streaming_chain_batch(spark: SparkSession, sf: str) -> DataFrame:
    b = chunks(spark, sf, K).select(F.col("asset_id").alias("stream_id"), F.col("chunk_ix").cast("bigint").alias("block_seq"), F.col("samples").alias("left"), F.transform("samples", lambda x: (x * 0.5).cast("float")).alias("right"))
    out = chain.batch(b, _CHAIN_RATE, _CHAIN)
    both = F.array(F.struct(F.lit(0).alias("channel"), F.col("left").alias("s")), F.struct(F.lit(1).alias("channel"), F.col("right").alias("s")))
    z = out.select("stream_id", "block_seq", F.explode(both).alias("c")).select("stream_id", "block_seq", "c.channel", F.posexplode("c.s").alias("k", "v"))
    return z.select("stream_id", "channel", (F.col("block_seq") * 64 + F.col("k")).alias("sample_ix"), (F.round(F.col("v").cast("double"), 5) + 0.0).alias("value"))


# ---- the whole pipeline ---------------------------------------------------------------------------------------------


def _recordings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, sf, _LOUD_K)
    return c, c.groupBy("asset_id").agg(F.lit(int(_LOUD_RATE)).alias("sample_rate"), F.sum(F.size("samples")).cast("bigint").alias("num_samples"))


_REPORT_SQL = f"""
WITH RECURSIVE {_LOUD_DESIGN}, s AS (SELECT a, i, x AS v FROM {samples_sql(_LOUD_K)}), n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
{_weighted_sql('s', 'kw', _LOUD_RATE)}, {_blocks_sql('kw', 400, 1600)}, {_gate_sql('g1')},
cut AS (SELECT s.a, i, {_real('CASE WHEN i >= 40 AND i < 120 THEN v * (1 - (CASE WHEN i - 40 < 20 THEN (i - 40) / 20.0 WHEN 120 - i <= 20 THEN (120 - i) / 20.0 ELSE 1.0 END)) ELSE v END')} AS v FROM s),
{_weighted_sql('cut', 'kw2', _LOUD_RATE)}, {_blocks_sql('kw2', 400, 1600).replace('b AS', 'b2 AS', 1)}, {_gate_sql('g2').replace('FROM b)', 'FROM b2)')},
gain AS (SELECT n.a, greatest(-24, least(24, -16 - coalesce(lufs, -100))) AS gain FROM n LEFT JOIN g2 USING (a)),
loud AS (SELECT a, i, {_real('v * pow(10, gain * 0.05)')} AS x FROM cut JOIN gain USING (a)),
p AS (SELECT a, i, x, max(abs(x)) OVER (PARTITION BY a ORDER BY i ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS peak FROM loud),
dd AS (SELECT a, i, x, CASE WHEN peak > pow(10, -0.05) THEN pow(10, -0.05) / peak ELSE 1.0::DOUBLE END AS d FROM p), r AS (SELECT 1 - exp(-1 / 200.0) AS r),
c AS (SELECT a, i, x, least(d, (1 - r) + r * d) AS g FROM dd, r WHERE i = 0 UNION ALL SELECT d.a, d.i, d.x, least(d.d, (1 - r) * c.g + r * d.d) FROM c JOIN dd d ON d.a = c.a AND d.i = c.i + 1, r),
fin AS (SELECT a, i, {_real('x * g')} AS v, g FROM c), {_weighted_sql('fin', 'kw3', _LOUD_RATE)}, {_blocks_sql('kw3', 400, 1600).replace('b AS', 'b3 AS', 1)}, {_gate_sql('g3').replace('FROM b)', 'FROM b3)')}
SELECT CAST(n.a AS VARCHAR) AS asset_id, CAST(n AS BIGINT) AS input_samples, CAST(n AS BIGINT) AS output_samples, round({_real('coalesce(g1.lufs, -100)')}, 3) AS input_lufs, round({_real('coalesce(g3.lufs, -100)')}, 3) AS final_lufs,
round({_real('20 * log10(ip)')}, 3) AS input_true_peak_db, round({_real('20 * log10(op)')}, 3) AS output_true_peak_db, round({_real('gain')}, 3) AS applied_gain_db, round({_real('20 * log10(lg)')}, 3) AS limiter_reduction_db, '40-120' AS censored
FROM n JOIN gain USING (a) LEFT JOIN g1 USING (a) LEFT JOIN g3 USING (a) JOIN (SELECT a, max(abs(v)) AS ip FROM s GROUP BY a) USING (a) JOIN (SELECT a, max(abs(v)) AS op, {_real('min(g)')} AS lg FROM fin GROUP BY a) USING (a)
"""


@query(_REPORT_SQL)
def pipeline_report(spark: SparkSession, sf: str) -> DataFrame:
    """Manual censoring, mastering and the report, with the stages that need no speech."""
    c, assets = _recordings(spark, sf)
    r = run(c, assets, _LOUD_RATE, PipelineOptions(denoise=False, censor=True, ranges=("10-30",))).report
    cut = F.array_join(F.transform("censored_ranges", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    numbers = ("input_lufs", "final_lufs", "input_true_peak_db", "output_true_peak_db", "applied_gain_db", "limiter_reduction_db")
    return r.select("asset_id", "input_samples", "output_samples", *[F.round(F.col(x).cast("double"), 3).alias(x) for x in numbers], cut.alias("censored"))


@query()
def pipeline_full(spark: SparkSession, sf: str) -> DataFrame:
    """All stages; each has its own query with SQL above."""
    c, assets = _recordings(spark, sf)
    o = PipelineOptions(silence=True, censor=True, ranges=("10-30",), denoise_settings=speech.DenoiseSettings(order=ORDER), gate_settings=speech.GateSettings(order=ORDER))
    return report.text_report(run(c, assets, _LOUD_RATE, o).report, o.dictionary)
