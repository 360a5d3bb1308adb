"""Concealing sample ranges by silence or a tone, with fades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant.functions.levels import gain_of, half_up
from sonorant.operators.ranges import overlap_join


def fade_envelope(from_start: Column, to_end: Column, fade: Column) -> Column:
    """How much of a sample is concealed: up over the first `fade` samples, down over the last, the end included."""
    up = (fade > 0) & (from_start < fade)
    down = (fade > 0) & (to_end <= fade)
    return F.when(up, from_start / fade).when(down, to_end / fade).otherwise(F.lit(1.0))


def beep_level(rms: Column, gain_db: float = 0.0) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.05), 2.0 * rms * gain_of(gain_db)))


def tone(from_start: Column, hz: float, rate: float) -> Column:
    """The tone's phase starts anew at each range."""
    return F.sin(F.lit(2.0 * math.pi * hz / rate) * from_start)


def concealed(dry: Column, from_start: Column, to_end: Column, fade: Column, wet: Column) -> Column:
    e = fade_envelope(from_start, to_end, fade)
    return dry * (1.0 - e) + wet * e


def range_rms(chunks: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("asset_id",), width: int = 1 << 18) -> DataFrame:
    """keys, channel, start, end, rms: the level of each channel within each range, over all chunks it touches."""
    c = chunks.select(*keys, "channel", "start_sample", (F.col("start_sample") + F.size("samples")).alias("stop"), "samples")
    part = overlap_join(c, ranges, list(keys), width, "start_sample", "stop")
    lo, hi = F.greatest("start", "start_sample") - F.col("start_sample"), F.least("end", "stop") - F.col("start_sample")
    energy = F.aggregate(F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return part.groupBy(*keys, "channel", "start", "end").agg(F.sqrt(F.sum(energy) / F.sum(hi - lo)).alias("rms"))


def censored(chunks: DataFrame, ranges: DataFrame, rate: float, mode: str = "mute", hz: float = 1000.0, gain_db: float = 0.0, fade_ms: float = 5.0, width: int = 1 << 18) -> DataFrame:
    """Chunk rows with the ranges concealed. ranges: asset_id, start, end; merged, within the signal.

    Only chunks that a range touches meet their ranges, through the binned interval join; the others pass unchanged.
    """
    fade_most = max(0, half_up(fade_ms * 0.001 * rate))
    r = ranges.where(F.col("end") > F.col("start"))
    keys = ["asset_id", "channel", "chunk_ix"]
    c = chunks.select(*keys, "start_sample", (F.col("start_sample") + F.size("samples")).alias("stop"))
    met = overlap_join(c, r, ["asset_id"], width, "start_sample", "stop").select(*keys, "start", "end")
    if mode == "beep":
        met = met.join(range_rms(chunks, r, width=width), ["asset_id", "channel", "start", "end"])
        met = met.withColumn("amp", beep_level(F.col("rms"), gain_db))
    else:
        met = met.withColumn("amp", F.lit(0.0))
    fade = F.least(F.lit(fade_most).cast("bigint"), F.call_function("div", F.col("end") - F.col("start"), F.lit(2).cast("bigint")))
    per_chunk = met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", fade.alias("fade"), "amp"))).alias("_ranges"))

    def rewrite(x: Column, i: Column) -> Column:
        at = F.col("start_sample") + i
        hit = F.get(F.filter("_ranges", lambda r: (r["start"] <= at) & (at < r["end"])), F.lit(0))
        wet = hit["amp"] * tone(at - hit["start"], hz, rate)
        return F.when(hit.isNull(), x).otherwise(concealed(x.cast("double"), at - hit["start"], hit["end"] - at, hit["fade"], wet).cast("float"))

    joined = chunks.join(per_chunk, keys, "left")
    samples = F.when(F.col("_ranges").isNull(), F.col("samples")).otherwise(F.transform("samples", rewrite))
    return joined.select("asset_id", "channel", "chunk_ix", "start_sample", samples.alias("samples"))
