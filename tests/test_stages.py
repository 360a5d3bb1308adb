"""Stages on generated signals, with the thresholds of the baseline."""

from __future__ import annotations

import numpy as np
import pytest

from sonorant.functions.levels import gain_of
from sonorant.operators import censor, dynamics, loudness, signal, spectral, speech
from sonorant.operators.filters import Biquad, filtered, high_pass
from sonorant.plans.options import PipelineOptions
from sonorant.plans.pipeline import run
from sonorant.sources.transcripts import TableTranscripts
from tests.signals import chunks, joined, rms, tones

RNG = np.random.default_rng(12345)


def test_fft_and_stft_give_the_signal_back():
    x = RNG.uniform(-1, 1, 5003)
    s = spectral.Stft(10, 4)
    assert np.abs(s.synthesise(s.analyse(x), len(x)) - x).max() < 1e-4
    z = RNG.uniform(-1, 1, 1024) + 1j * RNG.uniform(-1, 1, 1024)
    assert np.abs(np.fft.ifft(np.fft.fft(z)) - z).max() < 1e-4


@pytest.mark.parametrize("cuts", [1000, 64, 5003])
def test_frame_stream_equals_whole(cuts):
    x = RNG.uniform(-1, 1, 5003)
    s = spectral.Stft(8, 4)
    stream, add = spectral.FrameStream(s), spectral.OverlapAdd(s)
    spectra, out = [], []
    for at in range(0, len(x), cuts):
        f = stream.push(x[at : at + cuts])
        spectra.append(f)
        out.append(add.push(f))
    f = stream.close()
    out += [add.push(f), add.close()]
    assert np.allclose(np.concatenate([*spectra, f]), s.analyse(x))
    assert np.abs(np.concatenate(out)[: len(x)] - x).max() < 1e-4


def test_spectral_function_keeps_length(spark):
    x = RNG.uniform(-1, 1, 9001)
    out = spectral.transformed(chunks(spark, {"a": [x]}), spectral.Stft(8, 4), lambda: lambda f: f)
    assert np.abs(joined(out, "a") - x).max() < 1e-4


def test_voice_activity_floor_holds_under_speech():
    vad = speech.VoiceActivity()
    for _ in range(30):
        quiet = vad.step(np.full(513, 0.01))
    floor = vad.noise.mean()
    tonal = np.full(513, 0.01)
    tonal[::8] = 0.3
    for _ in range(30):
        p = vad.step(tonal)
    assert vad.noise.mean() < 3 * floor and p > quiet


def test_denoiser(spark):
    clean = tones(16_000, 16_000, 0.3, 0.8)
    noisy = clean + RNG.normal(0, 0.02, 16_000)
    out = speech.denoised(chunks(spark, {"a": [noisy]}))
    y = joined(out, "a")
    assert len(y) == len(noisy)
    assert rms(y[200:3000]) < 0.6 * rms(noisy[200:3000])
    assert rms(y[8000:12_000]) > 0.9 * rms(noisy[8000:12_000])
    r = speech.non_speech_ratio(out).first()
    assert 0 < r["non_speech_ratio"] < 1 and r["denoised_channels"] == 1


def test_silencer(spark):
    x = tones(16_000, 48_000, 0.4, 1.6) + RNG.normal(0, 0.001, 48_000)
    out, envelope = speech.silenced(chunks(spark, {"a": [x, x]}), 16_000.0)
    e, y = joined(envelope, "a", -1), joined(out, "a", 1)
    assert len(e) == len(y) == 48_000
    assert e[2000:5000].max() < 0.05 and e[45_000:47_500].max() < 0.05 and e[10_000:20_000].min() > 0.9
    assert ((e[6000:7000] > 0.1) & (e[6000:7000] < 0.9)).any()
    assert rms(y[45_000:47_500]) < 0.001
    r = speech.silenced_ratio(envelope).first()
    assert 0 < r["silenced_ratio"] < 1


def test_hold_of_zero_never_opens(spark):
    x = tones(16_000, 16_000, 0.2, 0.8)
    _, envelope = speech.silenced(chunks(spark, {"a": [x]}), 16_000.0, speech.GateSettings(hold_ms=0.0))
    assert joined(envelope, "a", -1).max() <= gain_of(-60.0) + 1e-6


@pytest.mark.parametrize("mode", ["mute", "beep"])
def test_censor(spark, mode):
    x = np.full(4000, 0.5)
    r = spark.createDataFrame([("a", 1000, 3000)], "asset_id string, start bigint, end bigint")
    y = joined(censor.censored(chunks(spark, {"a": [x]}, 700), r, 1000.0, mode, hz=100.0, width=512), "a")
    assert len(y) == 4000 and (y[:1000] == 0.5).all() and (y[3000:] == 0.5).all()
    if mode == "mute":
        assert np.abs(y[1010:2990]).max() < 1e-6
    else:  # twice the level, at most 0.95, whichever chunk a sample is in
        assert 0.9 < np.abs(y[1010:2990]).max() <= 0.95 + 1e-6


def test_beep_levels(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(*[censor.beep_level(F.lit(v)).alias(f"v{i}") for i, v in enumerate((0.0, 0.1, 1.0))]).first()
    assert tuple(got) == pytest.approx((0.05, 0.2, 0.95))


@pytest.mark.parametrize("size", [100, 8000])
def test_limiter(spark, size):
    x = 2.0 * np.sin(2 * np.pi * 220 * np.arange(8000) / 44_100)
    out = dynamics.limited(chunks(spark, {"a": [x]}, size), 44_100.0)
    y = joined(out, "a")
    assert len(y) == 8000 and np.abs(y).max() < gain_of(-1.0) + 1e-4
    assert dynamics.reduction_db(out).first()["limiter_reduction_db"] < -6
    whole = joined(dynamics.limited(chunks(spark, {"a": [x]}, 8000), 44_100.0), "a")
    assert np.allclose(y, whole, atol=1e-6)


def test_sliding_maximum():
    x = RNG.uniform(0, 1, 1003)
    for width in (1, 2, 7, 221, 2000):
        assert np.array_equal(dynamics.sliding_max(x, width), [x[i : i + width].max() for i in range(len(x))])


def test_loudness(spark):
    x = 0.1 * np.sin(2 * np.pi * 1000 * np.arange(144_000) / 48_000)
    short, quiet = x[:14_000], np.zeros(48_000)
    got = {r["asset_id"]: r["lufs"] for r in loudness.integrated(chunks(spark, {"stereo": [x, x], "mono": [x], "short": [short], "quiet": [quiet]}, 10_000), 48_000.0).collect()}
    assert -21.5 < got["stereo"] < -19.0 and got["stereo"] - got["mono"] == pytest.approx(3.01, abs=0.01)
    assert got["short"] == got["quiet"] == -100.0


@pytest.mark.parametrize("rate", [11_025, 22_050, 44_101])
def test_loudness_at_odd_rates(spark, rate):
    """Hops and blocks are rounded apart: a block need not be four hops."""
    x = RNG.normal(0, 0.1, rate * 2)
    hop, block = int(0.1 * rate + 0.5), int(0.4 * rate + 0.5)
    weighted = joined(loudness.k_weighted(chunks(spark, {"a": [x]}, 5000), rate), "a")
    squares = [float((weighted[i : i + block].astype(float) ** 2).mean()) for i in range(0, len(x) - block + 1, hop)]
    rows = loudness.blocks(loudness.chunk_hop_sums(loudness.k_weighted(chunks(spark, {"a": [x]}, 5000), rate), hop, block), hop, block).orderBy("block").collect()
    assert [r["mean_square"] for r in rows] == pytest.approx(squares, rel=1e-9)
    assert -40 < loudness.integrated(chunks(spark, {"a": [x]}, 5000), float(rate)).first()["lufs"] < 0


def test_sensitivity_is_held_within_bounds():
    assert speech.VoiceActivity(7.0).sensitivity == 1.0 and speech.VoiceActivity(-1.0).sensitivity == 0.0


def test_true_peak(spark):
    x = RNG.uniform(-1, 1, 5000)
    got = {r["asset_id"]: r["true_peak_db"] for r in signal.true_peak(chunks(spark, {"a": [x], "quiet": [np.zeros(10)]})).collect()}
    assert got["a"] == pytest.approx(20 * np.log10(np.abs(x).max()), abs=1e-4) and got["quiet"] == -100.0


def test_filter_in_blocks_equals_recursion(spark):
    x, c = RNG.uniform(-1, 1, 1000), high_pass(48_000.0)
    want, z1, z2 = [], 0.0, 0.0
    for v in x:
        y = c.b0 * v + z1
        z1, z2 = c.b1 * v - c.a1 * y + z2, c.b2 * v - c.a2 * y
        want.append(y)
    got = joined(filtered(chunks(spark, {"a": [x]}, 77), lambda: [Biquad(c)]), "a")
    assert np.allclose(got, want, atol=1e-6)


def test_resampler(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(48_000) / 48_000)
    y = spectral.resample(x, 48_000, 16_000)
    assert len(y) == 16_000
    want = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000)
    assert np.abs(y[100:-100] - want[100:-100]).max() < 0.05
    pieces = joined(spectral.resampled_chunks(chunks(spark, {"a": [x]}, 5000), 48_000, 16_000, size=2000), "a")
    assert np.allclose(pieces, y, atol=1e-6)


def test_mixdown_chunks(spark):
    a, b = RNG.uniform(-1, 1, 1000), RNG.uniform(-1, 1, 1000)
    assert np.allclose(joined(signal.mixdown_chunks(chunks(spark, {"a": [a, b]}, 300)), "a", -1), (a + b) / 2, atol=1e-6)


def test_pipeline_keeps_lengths(spark, tmp_path):
    x = tones(16_000, 24_000, 0.3, 1.2) * 0.3 + RNG.normal(0, 0.005, 24_000)
    c = chunks(spark, {"a": [x, x * 0.5], "b": [x[:9000]]})
    assets = spark.createDataFrame([("a", 16_000, 24_000), ("b", 16_000, 9000)], "asset_id string, sample_rate int, num_samples bigint")
    words = spark.createDataFrame([("a", 0, "fuck", 400, 500, 0.9), ("a", 1, "class", 600, 700, 0.9)], "asset_id string, word_ix int, text string, start_ms bigint, end_ms bigint, probability float")
    o = PipelineOptions(silence=True, censor=True, ranges=("100-200",))
    r = run(c, assets, 16_000.0, o, TableTranscripts(words), str(tmp_path))
    rows = {x["asset_id"]: x for x in r.report.collect()}
    assert all(x["input_samples"] == x["output_samples"] for x in rows.values())
    assert [(g["start"], g["end"]) for g in rows["a"]["censored_ranges"]] == [(1600, 3200), (5760, 8640)]
    assert [(g["start"], g["end"]) for g in rows["b"]["censored_ranges"]] == [(1600, 3200)]
    assert len(rows["a"]["transcript"]) == 2 and rows["a"]["denoised_channels"] == 2
    y = joined(r.chunks, "a")
    assert np.abs(y).max() <= gain_of(-1.0) + 1e-3 and np.abs(y[6000:8400]).max() < 1e-5


def test_manual_ranges_need_censoring(spark):
    x = tones(16_000, 8000, 0.1, 0.4)
    assets = spark.createDataFrame([("a", 16_000, 8000)], "asset_id string, sample_rate int, num_samples bigint")
    off = PipelineOptions(denoise=False, mastering=False, ranges=("0-500",))
    r = run(chunks(spark, {"a": [x]}), assets, 16_000.0, off)
    assert np.allclose(joined(r.chunks, "a"), x, atol=1e-6) and not r.report.first()["censored_ranges"]
