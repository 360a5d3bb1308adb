"""The batch pipeline over many recordings: measure, denoise, silence, censor, master, measure.

Every stage keeps each recording's number of samples. Disabled stages are not in the plan. Recordings (and channels,
where a stage has them apart) are independent keys, so a run is as parallel as there are recordings. Results that several
later steps read are written once and read again where there is a shared folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.functions.levels import db_to_gain
from sonorant.operators import censor, dynamics, loudness, ranges, signal, speech
from sonorant.plans.options import PipelineOptions
from sonorant.schemas import NO_LEVEL
from sonorant.sources.ranges import manual_ranges
from sonorant.sources.transcripts import TranscriptProvider


@dataclass(frozen=True)
class Result:
    chunks: DataFrame
    report: DataFrame
    words: DataFrame
    ranges: DataFrame


def _keep(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Written and read again under folder, so that later readers do not run the stage anew."""
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lengths(chunks: DataFrame, name: str) -> DataFrame:
    """asset_id and the number of samples of channel 0."""
    return chunks.where("channel = 0").groupBy("asset_id").agg(F.sum(F.size("samples")).cast("bigint").alias(name))


def run(chunks: DataFrame, assets: DataFrame, rate: float, options: PipelineOptions | None = None, provider: TranscriptProvider | None = None, folder: str | None = None) -> Result:
    """Clean recordings of one sample rate. chunks: PCM_CHUNKS; assets: asset_id, sample_rate, num_samples.

    folder: a path that all executors share, for results that are read more than once; spark.checkpoint.dir by default,
    and without either they are computed again. What is written stays until the caller removes it.
    """
    o, spark = options or PipelineOptions(), chunks.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    source = chunks.select("asset_id", "channel", "chunk_ix", "start_sample", "samples")
    report = assets.select("asset_id").join(_lengths(source, "input_samples"), "asset_id", "left").fillna(0, ["input_samples"])
    report = report.join(loudness.integrated(source, rate).withColumnRenamed("lufs", "input_lufs"), "asset_id", "left")
    report = report.join(signal.true_peak(source).withColumnRenamed("true_peak_db", "input_true_peak_db"), "asset_id", "left")
    now = source
    if o.denoise:
        clean = _keep(speech.denoised(now, o.denoise_settings), folder, "denoised")
        report = report.join(speech.non_speech_ratio(clean), "asset_id", "left")
        now = clean.drop("frames", "quiet_frames")
    else:
        report = report.withColumns({"non_speech_ratio": F.lit(0.0), "denoised_channels": F.lit(0)})
    if o.silence:
        now, envelope = speech.silenced(now, rate, o.gate_settings)
        report = report.join(speech.silenced_ratio(envelope).select("asset_id", "silenced_ratio"), "asset_id", "left")
        now = _keep(now, folder, "silenced")
    else:
        report = report.withColumn("silenced_ratio", F.lit(0.0))
    words = spark.createDataFrame([], "asset_id string, word_ix int, text string, start_ms bigint, end_ms bigint, probability float")
    merged = spark.createDataFrame([], "asset_id string, start bigint, end bigint")
    if o.censor:  # manual ranges take effect only here
        sized = assets.select("asset_id", "sample_rate", "num_samples")
        found = manual_ranges(sized, list(o.ranges))
        if provider is not None:
            words = _keep(provider.transcribe(signal.mixdown_chunks(now), rate), folder, "words")
            found = ranges.union_merge(found, ranges.from_words(words.join(sized, "asset_id"), o.dictionary, o.censor_margin_ms), ["asset_id"])
        merged = _keep(ranges.merge(found.join(sized.select("asset_id", "num_samples"), "asset_id"), ["asset_id"], total="num_samples"), folder, "ranges")
        now = _keep(censor.censored(now, merged, rate, o.censor_mode, o.beep_hz, o.beep_gain_db, o.fade_ms), folder, "censored")
    if o.mastering:
        level = loudness.integrated(now, rate)
        gain = _keep(level.select("asset_id", loudness.mastering_gain_db(F.col("lufs"), o.target_lufs, o.gain_limit_db).alias("applied_gain_db")), folder, "gains")
        loud = now.join(gain, "asset_id").select("asset_id", "channel", "chunk_ix", "start_sample", F.transform("samples", lambda x: (x * db_to_gain(F.col("applied_gain_db"))).cast("float")).alias("samples"))
        held = _keep(dynamics.limited(loud, rate, o.ceiling_db, o.ahead_ms, o.release_ms), folder, "limited")
        report = report.join(gain, "asset_id", "left").join(dynamics.reduction_db(held), "asset_id", "left")
        now = held.drop("least_gain")
    else:
        report = report.withColumns({"applied_gain_db": F.lit(0.0), "limiter_reduction_db": F.lit(0.0)})
    report = report.join(_lengths(now, "output_samples"), "asset_id", "left").fillna(0, ["output_samples"])
    report = report.join(loudness.integrated(now, rate).withColumnRenamed("lufs", "final_lufs"), "asset_id", "left")
    report = report.join(signal.true_peak(now).withColumnRenamed("true_peak_db", "output_true_peak_db"), "asset_id", "left")
    word = F.struct("word_ix", "text", "start_ms", "end_ms", "probability")
    said = words.groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list(word)), lambda w: F.struct(w["text"].alias("text"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["probability"].alias("probability"))).alias("transcript"))
    cut = merged.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("censored_ranges"))
    report = report.join(said, "asset_id", "left").join(cut, "asset_id", "left")
    floats = ("input_lufs", "final_lufs", "input_true_peak_db", "output_true_peak_db", "applied_gain_db", "limiter_reduction_db", "non_speech_ratio", "silenced_ratio")
    empty = F.col("input_samples") == 0  # an empty recording reports zeros

    def number(c: str):
        return F.when(empty, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.lit(NO_LEVEL if c.endswith(("lufs", "peak_db")) else 0.0))).cast("float").alias(c)

    report = report.select(
        "asset_id", "input_samples", "output_samples", *[number(c) for c in floats], F.coalesce("denoised_channels", F.lit(0)).alias("denoised_channels"),
        F.coalesce("transcript", F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint,probability:float>>")).alias("transcript"), F.coalesce("censored_ranges", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("censored_ranges"),
    )
    return Result(now, report, words, merged)
