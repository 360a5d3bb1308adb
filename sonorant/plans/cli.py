"""Command line: clean one WAV file or a folder of them.

    spark-submit -m sonorant.plans.cli <input> <output folder> [options]
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession

from sonorant.functions.dictionary import Dictionary
from sonorant.operators import report as reports
from sonorant.operators.speech import DenoiseSettings, GateSettings
from sonorant.plans.options import PipelineOptions
from sonorant.plans.pipeline import run
from sonorant.sources import wav
from sonorant.sources.ranges import default_model, first_existing, model_folders, vad_model_beside
from sonorant.sources.transcripts import RecogniserOptions, RecogniserTranscripts, TableTranscripts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sonorant", description="Offline cleanup, censoring and mastering of speech recordings", allow_abbrev=False)
    p.add_argument("input")
    p.add_argument("output")
    flags = ("no-denoise", "silence-non-speech", "censor", "no-vad", "no-mastering")
    numbers = {
        "denoise-reduction": 12.0, "speech-protection": 0.9, "vad-sensitivity": 0.5, "silence-threshold": 0.35, "silence-sensitivity": 0.5, "silence-attack-ms": 30.0, "silence-release-ms": 150.0,
        "silence-hold-ms": 150.0, "silence-floor-db": -60.0, "beep-hz": 1000.0, "beep-gain-db": 0.0, "target-lufs": -16.0, "ceiling-db": -1.0,
    }
    for f in flags:
        p.add_argument(f"--{f}", action="store_true")
    for n, default in numbers.items():
        p.add_argument(f"--{n}", type=float, default=default)
    p.add_argument("--censor-mode", choices=("mute", "beep"), default="mute")
    p.add_argument("--censor-margin-ms", type=int, default=40)
    p.add_argument("--range", action="append", default=[], metavar="START-END", help="manual censor range in ms")
    p.add_argument("--words", default="", help="transcript words as Parquet")
    p.add_argument("--model", default="")
    p.add_argument("--vad-model", default="")
    p.add_argument("--language", default="auto")
    p.add_argument("--threads", type=int, default=0)
    p.add_argument("--beam-size", type=int, default=5)
    p.add_argument("--bit-depth", type=int, choices=(16, 32), default=16)
    p.add_argument("--folder", default=None, help="shared folder for results that are read twice")
    return p


def options(a: argparse.Namespace) -> PipelineOptions:
    return PipelineOptions(
        denoise=not a.no_denoise,
        denoise_settings=replace(DenoiseSettings(), reduction_db=a.denoise_reduction, speech_protection=a.speech_protection, sensitivity=a.vad_sensitivity),
        silence=a.silence_non_speech,
        gate_settings=replace(GateSettings(), open_threshold=a.silence_threshold, sensitivity=a.silence_sensitivity, attack_ms=a.silence_attack_ms, release_ms=a.silence_release_ms, hold_ms=a.silence_hold_ms, floor_db=a.silence_floor_db),
        censor=a.censor, censor_mode=a.censor_mode, beep_hz=a.beep_hz, beep_gain_db=a.beep_gain_db, censor_margin_ms=a.censor_margin_ms, ranges=tuple(a.range),
        mastering=not a.no_mastering, target_lufs=a.target_lufs, ceiling_db=a.ceiling_db,
    )


def recogniser(a: argparse.Namespace, load: Callable[[dict[str, object]], Callable] | None = None) -> RecogniserTranscripts:
    """The recogniser that the options name; not ready without a backend or a model file.

    A model is a path or a file name in one of the model folders, or "auto" for the default one there; the
    speech-activity model lies beside it by default.
    """
    folders = model_folders(os.getcwd(), os.path.dirname(os.path.abspath(sys.argv[0])), "")
    path = (default_model(folders) if a.model == "auto" else first_existing([a.model, *(os.path.join(f, a.model) for f in folders)])) or ""
    vad = "" if a.no_vad else a.vad_model or vad_model_beside(path) or ""
    return RecogniserTranscripts(RecogniserOptions(model_path=path, vad_model_path=vad, language=a.language, beam_size=a.beam_size, use_vad=not a.no_vad, threads=a.threads), load)


def invalid(spark: SparkSession, a: argparse.Namespace) -> str | None:
    """What is wrong with the paths of a run, if anything; checked before any work."""

    def resolved(path: str) -> tuple[str, bool]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs.makeQualified(p).toString().rstrip("/"), bool(fs.globStatus(p))

    if not a.input or not resolved(a.input)[1]:
        return f"choose an existing input, not '{a.input}'"
    if not a.output:
        return "choose an output folder"
    if resolved(a.input)[0] == resolved(a.output)[0]:
        return "the output must differ from the input"
    return None


def main(argv: list[str] | None = None, load: Callable[[dict[str, object]], Callable] | None = None) -> int:
    """0: done; 1: an unknown option, an unreadable input or model; 2: a number of samples changed. load: a recogniser backend."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    provider = None
    if a.censor and a.model:
        if a.words:
            print("Error: --words and --model are two sources of words", file=sys.stderr)
            return 1
        provider = recogniser(a, load)
        if not provider.is_ready():
            why = "no recogniser backend is available" if provider.options.model_path else "no such file"
            print(f"Error: could not load model '{a.model}': {why}", file=sys.stderr)
            return 1
        print(f"Speech recognition: {provider.name}")
    elif a.censor and not a.words:
        print("No --model or --words given: censoring only the manual --range entries.")
    spark = SparkSession.builder.appName("sonorant").getOrCreate()
    if why := invalid(spark, a):
        print(f"Error: {why}", file=sys.stderr)
        return 1
    assets = wav.read_assets(spark, a.input)
    bad = assets.where("error IS NOT NULL").select("path", "error").take(20)
    for r in bad:
        print(f"Error: {r['path']}: {r['error']}", file=sys.stderr)
    good = assets.where("error IS NULL")
    rates = [r["sample_rate"] for r in good.select("sample_rate").distinct().collect()]  # a handful
    if not rates:
        return 1
    if a.words:
        provider = TableTranscripts.read(spark, a.words)
    code, common = 1 if bad else 0, wav.common_folder(good)
    wav.check_names(good, common)
    for rate in sorted(rates):
        some = good.where(good["sample_rate"] == rate)
        result = run(wav.read_chunks(spark, a.input).join(some.select("asset_id"), "asset_id", "left_semi"), some, float(rate), options(a), provider, a.folder)
        wav.write(result.chunks, some, a.output, a.bit_depth, common).count()
        for r in reports.text_report(result.report, Dictionary(), show_silenced=a.silence_non_speech).toLocalIterator():
            print(f"---- {r['asset_id']} ----\n{r['text']}")
        if not reports.changed_lengths(result.report).isEmpty():
            code = 2
    return code


if __name__ == "__main__":
    sys.exit(main())
