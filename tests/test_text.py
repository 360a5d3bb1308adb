"""Dictionary, ranges, tokens, report, sources, command line."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from sonorant.functions import text as tx
from sonorant.functions.dictionary import Dictionary
from sonorant.operators import match, ranges, report, tokens
from sonorant.plans import cli
from sonorant.schemas import REPORT, TOKENS
from sonorant.sources import wav
from sonorant.sources.ranges import default_model, manual_ranges, model_folders, vad_model_beside
from sonorant.sources.transcripts import RecogniserOptions, RecogniserTranscripts
from tests.signals import chunks


def flagged(spark, words, dictionary=None):
    df = spark.createDataFrame([(w,) for w in words], "text string")
    return {r["text"] for r in match.listed(df, dictionary or Dictionary()).collect()}


def test_dictionary_words(spark):
    hits = ["fuck", "Fucking!", "f.u.c.k", "хуйня", "Xуйня", "сууука"]
    misses = ["class", "хлеб", "Херсон", "", "123"]
    assert flagged(spark, hits + misses) == set(hits)
    over = ["location", "команда", "рубля"]  # roots match inside ordinary words, as they always did
    assert flagged(spark, over) == set(over)


def test_normal_form_in_both_engines(spark):
    from pyspark.sql import functions as F

    words = ["Hello", "ЁЖИК", "aaabbb", "a-a", "Привет, мир", "", "СССР"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(tx.normalise(F.col("w"))).collect()] == [tx.normalise_text(w) for w in words]


def test_extended_dictionary_and_minimal_roots():
    d = Dictionary().with_root("Foo!").with_word("Bar").with_root("--")
    assert d.roots[-1] == tx.normalise_text("foo") and d.words[-1] == tx.normalise_text("bar")
    assert len(Dictionary().roots) == 57 and len(Dictionary().words) == 19 and len(Dictionary().minimal_roots()) == 43


def test_semi_join_equals_contains(spark):
    words = spark.createDataFrame([("abcde",), ("xab",), ("zz",), ("b",), ("",)], "norm string")
    roots = spark.createDataFrame([("bcd",), ("ab",), ("b",), ("",)], "entry string")
    assert {r[0] for r in match.semi_join_roots(words, roots).collect()} == {"abcde", "xab", "b"}


def test_word_ranges(spark):
    rows = [("a", "fuck", 0, 500), ("a", "hello", 550, 560), ("a", "shit", 600, 900), ("a", "bitch", 1400, 1700)]
    w = spark.createDataFrame([(*r, 1000, 5000) for r in rows], "asset_id string, text string, start_ms bigint, end_ms bigint, sample_rate int, num_samples bigint")
    got = sorted((r["start"], r["end"]) for r in ranges.from_words(w, Dictionary(), 50).collect())
    assert got == [(0, 950), (1350, 1750)]


def test_merge(spark):
    r = spark.createDataFrame([("a", s, e) for s, e in [(0, 10), (10, 20), (25, 30), (26, 28), (29, 40), (50, 50), (60, 55)]], "asset_id string, start bigint, end bigint")
    assert sorted((x["start"], x["end"]) for x in ranges.merge(r, ["asset_id"]).collect()) == [(0, 20), (25, 40)]


def test_overlap_join_equals_nested_loop(spark):
    rng = np.random.default_rng(3)
    c = [("a", int(s), int(s + d)) for s, d in zip(rng.integers(0, 500, 60), rng.integers(0, 90, 60), strict=True)]
    r = [("a", int(s), int(s + d)) for s, d in zip(rng.integers(-50, 500, 60), rng.integers(0, 200, 60), strict=True)]
    left = spark.createDataFrame(c, "k string, lo bigint, hi bigint")
    right = spark.createDataFrame(r, "k string, start bigint, end bigint")
    got = sorted((x["lo"], x["hi"], x["start"], x["end"]) for x in ranges.overlap_join(left, right, ["k"], 37).collect())
    want = sorted((lo, hi, s, e) for _, lo, hi in c for _, s, e in r if lo < hi and s < e and s < hi and e > lo)
    assert got == want


def test_tokens_to_words(spark):
    rows = [("a", 0, i, tid, t, 10 * i, 10 * i + 10, p) for i, (tid, t, p) in enumerate([(1, " he", 0.5), (1, "llo", 1.0), (1, " wor", 0.2), (60_000, " special", 0.1), (1, "", 0.1), (1, None, 0.1), (1, "ld", 0.4)])]
    got = tokens.to_words(spark.createDataFrame(rows, TOKENS), 50_257).orderBy("word_ix").collect()
    assert [(r["word_ix"], r["text"], r["start_ms"], r["end_ms"]) for r in got] == [(0, "hello", 0, 200), (1, "world", 200, 700)]
    assert [r["probability"] for r in got] == pytest.approx([0.75, 0.3])


def wave(tag, bits, frames: bytes, channels=1, rate=8000, extra=b"", before=b""):
    align = channels * bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * align, align, bits) + extra
    body = b"WAVE" + before + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(frames)) + frames
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("channels", [1, 2])
@pytest.mark.parametrize("kind", ["i2", "i3", "i4", "f4", "f8", "ext"])
def test_wav_encodings(spark, tmp_path, channels, kind):
    x = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.75])
    extra, tag = b"", 1
    if kind in ("f4", "f8"):
        raw, bits, tag = x.astype(f"<{kind}").tobytes(), int(kind[1]) * 8, 3
    elif kind == "i3":
        raw, bits = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x), 24
    else:
        bits = 16 if kind in ("i2", "ext") else 32
        raw = (x * (1 << (bits - 1))).astype(f"<i{bits // 8}").tobytes()
        if kind == "ext":
            tag, extra = 0xFFFE, struct.pack("<HHIH", 22, 16, 0, 1) + bytes(14)
    junk = b"junk" + struct.pack("<I", 3) + b"abc\0"
    (tmp_path / "x.wav").write_bytes(wave(tag, bits, raw, channels, extra=extra, before=junk))
    a = wav.read_assets(spark, str(tmp_path)).first()
    assert (a["sample_rate"], a["channels"], a["num_samples"], a["bits"], a["error"]) == (8000, channels, 6 // channels, bits, None)
    rows = wav.read_chunks(spark, str(tmp_path), chunk=2).orderBy("channel", "chunk_ix").collect()
    for c in range(channels):
        assert np.allclose(np.concatenate([r["samples"] for r in rows if r["channel"] == c]), x[c::channels])


def test_wav_errors(spark, tmp_path):
    (tmp_path / "magic.wav").write_bytes(b"RIFX" + bytes(40))
    (tmp_path / "short.wav").write_bytes(b"RIFF" + bytes(4) + b"WAVEfmt " + struct.pack("<I", 8) + bytes(8))
    (tmp_path / "nodata.wav").write_bytes(wave(1, 16, b""))
    (tmp_path / "eight.wav").write_bytes(wave(1, 8, b"\x10\x20"))
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in wav.read_assets(spark, str(tmp_path)).collect()}
    assert got == {"magic.wav": wav.NOT_RIFF, "short.wav": wav.BAD_FORMAT, "nodata.wav": wav.INCOMPLETE, "eight.wav": None}
    assert [list(r["samples"]) for r in wav.read_chunks(spark, str(tmp_path)).collect()] == [[0.0, 0.0]]


@pytest.mark.parametrize("bits", [16, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    x = np.random.default_rng(1).uniform(-1.2, 1.2, 5000).astype(np.float32)
    c = chunks(spark, {"dir/in.wav": [x, -x]}, 700)
    assets = spark.createDataFrame([("dir/in.wav", 16_000, 2, 5000)], "asset_id string, sample_rate int, channels int, num_samples bigint")
    done = wav.write(c, assets, str(tmp_path), bits).collect()
    assert [r["path"] for r in done] == [f"{tmp_path}/in_clean.wav"]
    w = wav.parse((tmp_path / "in_clean.wav").read_bytes())
    y = wav.decode(w, 0, w.samples)
    assert (w.rate, w.channels, w.samples) == (16_000, 2, 5000)
    assert np.abs(y[0] - np.clip(x, -1, 1)).max() < (1e-4 if bits == 16 else 1e-7)


def test_manual_ranges_and_models(spark):
    assets = spark.createDataFrame([("a", 8000)], "asset_id string, sample_rate int")
    got = sorted((r["start"], r["end"]) for r in manual_ranges(assets, ["100-200.7", "no", "5-"]).collect())
    assert got == [(40, 0), (800, 1600)] and manual_ranges(assets, []).count() == 0
    assert vad_model_beside("/m/x.bin", exists=lambda p: p == "/m/ggml-silero-v5.1.2.bin") == "/m/ggml-silero-v5.1.2.bin"
    assert vad_model_beside("/m/x.bin", exists=lambda p: False, files=lambda f: ["x.bin", "my-Silero.bin"] if f == "/m/" else []) == "/m/my-Silero.bin"
    assert model_folders("/a/b", "/a", "/u")[:5] == ["/u", "/a/b/models", "/a/b", "/a/models", "/a"]
    there = {"/a": ["ggml-silero-v6.2.0.bin", "ggml-tiny.bin"], "/b": ["ggml-base.bin"]}
    assert default_model(["/a", "/b"], lambda p: p == "/b/ggml-base.bin", lambda d: there.get(d, [])) == "/b/ggml-base.bin"
    assert default_model(["/c", "/a"], lambda p: False, lambda d: there.get(d, [])) == "/a/ggml-tiny.bin" and default_model(["/c"], lambda p: False, lambda d: []) is None


def test_outputs_of_equal_names(spark, tmp_path):
    assets = spark.createDataFrame([(f"file:/in/{d}/same.wav", 8000, 1, 3) for d in "xy"], "asset_id string, sample_rate int, channels int, num_samples bigint")
    c = chunks(spark, {f"file:/in/{d}/same.wav": [np.array([v, v, v], dtype=np.float32)] for d, v in (("x", 0.25), ("y", 0.5))}, 2)
    done = {r["path"] for r in wav.write(c, assets, str(tmp_path), 32).collect()}
    assert done == {f"{tmp_path}/{d}/same_clean.wav" for d in "xy"}
    w = wav.parse((tmp_path / "y" / "same_clean.wav").read_bytes())
    assert wav.decode(w, 0, 3).tolist() == [[0.5, 0.5, 0.5]] and len(list(tmp_path.rglob("*.wav*"))) == 2
    clash = spark.createDataFrame([("/in/a.wav",), ("/in/a.WAV",)], "asset_id string")
    with pytest.raises(wav.WavError):
        wav.check_names(clash, wav.common_folder(clash))


def test_margin_and_time_become_samples_apart(spark):
    w = spark.createDataFrame([("a", "fuck", 1000, 1100, 44_100, 100_000)], "asset_id string, text string, start_ms bigint, end_ms bigint, sample_rate int, num_samples bigint")
    r = ranges.from_words(w, Dictionary(), 41).first()
    assert (r["start"], r["end"]) == (44_100 - 1808, 48_510 + 1808)


def test_invalid_runs(spark, tmp_path):
    import argparse

    def run(source, target):
        return cli.invalid(spark, argparse.Namespace(input=source, output=target))

    assert "existing" in run(str(tmp_path / "none"), "/o") and "differ" in run(str(tmp_path), str(tmp_path) + "/") and "output" in run(str(tmp_path), "")
    assert run(str(tmp_path), str(tmp_path / "out")) is None


def test_recogniser_backend(spark):
    seen = []

    def load(options):
        assert options["strategy"] == "beam" and options["language"] is None and not options["vad"]

        def recognise(samples):
            return [{"segment_ix": 0, "token_ix": i, "token_id": 1, "text": t, "t0_cs": i, "t1_cs": i + 1, "p": 1.0} for i, t in enumerate((" one", " two"))] if len(samples) else []

        return recognise

    p = RecogniserTranscripts(RecogniserOptions(model_path="/m/base.bin"), load)
    mono = chunks(spark, {"a": [np.zeros(4800)], "b": [np.zeros(4800)]}, 1000)
    got = sorted((r["asset_id"], r["text"]) for r in p.transcribe(mono, 48_000.0).collect())
    assert got == [("a", "one"), ("a", "two"), ("b", "one"), ("b", "two")] and not seen
    assert "base.bin" in p.name and not RecogniserTranscripts(RecogniserOptions()).is_ready()
    assert RecogniserTranscripts(RecogniserOptions()).transcribe(mono, 48_000.0).count() == 0


def test_command_line_recogniser(tmp_path, capsys):
    from sonorant.plans import cli

    model, vad = tmp_path / "base.bin", tmp_path / "ggml-silero-v5.1.2.bin"
    args = ["in", "out", "--censor", "--language", "de", "--threads", "3", "--beam-size", "2", "--model", str(model)]
    assert cli.main(args) == 1 and "no such file" in capsys.readouterr().err
    model.touch()
    vad.touch()
    assert cli.main(args) == 1 and "no recogniser backend" in capsys.readouterr().err
    assert cli.main([*args, "--words", "w"], lambda o: None) == 1
    p = cli.recogniser(cli.parser().parse_args(args), lambda o: None)
    assert p.is_ready() and p.options == RecogniserOptions(str(model), str(vad), "de", 2, threads=3)
    o = cli.recogniser(cli.parser().parse_args([*args, "--no-vad"]), lambda o: None).options
    assert not o.use_vad and not o.vad_enabled()


def test_text_report(spark):
    row = ("a", 100, 100, -20.0, -16.0, -3.5, -1.0, 4.0, -0.5, 0.25, 1, 0.125, [("fuck", 0, 100, 0.5), ("ok", 100, 200, 0.5)], [(0, 10)])
    df = spark.createDataFrame([row], REPORT)
    lines = report.text_report(df, Dictionary(), 2).first()["text"].split("\n")
    assert lines[0] == "Loudness: -20.00 -> -16.00 LUFS" and lines[3] == "Non-speech ratio: 0.250"
    assert lines[5:] == ["Censored ranges: 1", "  [0, 10) samples", "Transcript (2 words):", "  [*] [0-100 ms] fuck", "      [100-200 ms] ok", "Duration preserved: 100 samples."]
    assert len(report.text_report(df, Dictionary(), show_silenced=False).first()["text"].split("\n")) == len(lines) - 1
    assert tuple(report.counts(df).first())[1:] == (2, 1, 100) and report.changed_lengths(df).isEmpty()


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["in", "out", "--unknown"]) == 1
    (tmp_path / "in").mkdir()
    x = (0.2 * np.sin(2 * np.pi * 300 * np.arange(8000) / 8000) * 32767).astype("<i2")
    (tmp_path / "in" / "t.wav").write_bytes(wave(1, 16, x.tobytes()))
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out"), "--censor", "--range", "100-200", "--no-denoise"]) == 0
    out = wav.parse((tmp_path / "out" / "t_clean.wav").read_bytes())
    assert out.samples == 8000 and np.abs(wav.decode(out, 900, 600)).max() < 1e-4
    assert "Duration preserved: 8000 samples." in capsys.readouterr().out
