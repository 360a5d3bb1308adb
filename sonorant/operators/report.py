"""The report of a run, as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant.functions.dictionary import Dictionary
from sonorant.functions.text import flag_line, normalise
from sonorant.operators.match import is_listed


def counts(report: DataFrame) -> DataFrame:
    """asset_id, words, ranges, samples."""
    return report.select("asset_id", F.size("transcript").cast("bigint").alias("words"), F.size("censored_ranges").cast("bigint").alias("ranges"), F.col("output_samples").alias("samples"))


def text_report(report: DataFrame, dictionary: Dictionary, decimals: int | None = None, show_silenced: bool = True) -> DataFrame:
    """asset_id, text. With decimals (levels so many, ratios one more) as a window shows it, else as a console does."""

    def level(c: str) -> Column:
        return F.format_string(f"%.{decimals}f", F.col(c).cast("double")) if decimals is not None else F.format_string("%s", F.col(c).cast("string"))

    def ratio(c: str) -> Column:
        return F.format_string(f"%.{decimals + 1}f", F.col(c).cast("double")) if decimals is not None else F.format_string("%s", F.col(c).cast("string"))

    ranges = F.transform("censored_ranges", lambda r: F.format_string("  [%d, %d) samples", r["start"], r["end"]))
    rows = F.transform("transcript", lambda w: flag_line(w["text"], w["start_ms"], w["end_ms"], is_listed(normalise(w["text"]), dictionary)))
    lines = [
        F.array(F.concat(F.lit("Loudness: "), level("input_lufs"), F.lit(" -> "), level("final_lufs"), F.lit(" LUFS"))),
        F.array(F.concat(F.lit("True peak: "), level("input_true_peak_db"), F.lit(" -> "), level("output_true_peak_db"), F.lit(" dBFS"))),
        F.array(F.concat(F.lit("Mastering gain: "), level("applied_gain_db"), F.lit(" dB, limiter reduction: "), level("limiter_reduction_db"), F.lit(" dB"))),
        F.array(F.concat(F.lit("Non-speech ratio: "), ratio("non_speech_ratio"))),
        F.array(F.concat(F.lit("Silenced (non-speech) ratio: "), ratio("silenced_ratio"))) if show_silenced else F.array().cast("array<string>"),
        F.array(F.format_string("Censored ranges: %d", F.size("censored_ranges"))),
        ranges,
        F.when(F.size("transcript") > 0, F.concat(F.array(F.format_string("Transcript (%d words):", F.size("transcript"))), rows)).otherwise(F.array().cast("array<string>")),
        F.array(F.when(F.col("input_samples") == F.col("output_samples"), F.format_string("Duration preserved: %d samples.", F.col("input_samples"))).otherwise(F.format_string("ERROR: sample count changed (%d -> %d)", F.col("input_samples"), F.col("output_samples")))),
    ]
    return report.select("asset_id", F.array_join(F.concat(*lines), "\n").alias("text"))


def changed_lengths(report: DataFrame) -> DataFrame:
    """Assets whose number of samples changed; there must be none."""
    return report.where(F.col("input_samples") != F.col("output_samples"))
