"""Sample-level relations: chunk rows, exploded rows, mixdown, gain, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant.schemas import NO_LEVEL


def exploded(chunks: DataFrame) -> DataFrame:
    """asset_id, channel, sample_ix, value of chunk rows."""
    return chunks.select("asset_id", "channel", "start_sample", F.posexplode("samples").alias("_i", "value")).select("asset_id", "channel", (F.col("start_sample") + F.col("_i")).alias("sample_ix"), "value")


def mixdown_chunks(chunks: DataFrame) -> DataFrame:
    """Mixdown of aligned chunk rows: arrays are added as they are, no sample row is made. Channel -1 is the mix."""
    by = chunks.groupBy("asset_id", "chunk_ix", "start_sample").agg(F.collect_list("samples").alias("all"))
    first = F.transform(F.col("all")[0], lambda x: x.cast("double"))
    total = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), first, lambda a, b: F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0))))
    mean = F.transform(total, lambda x: (x / F.size("all")).cast("float"))
    return by.select("asset_id", F.lit(-1).alias("channel"), "chunk_ix", "start_sample", mean.alias("samples"))


def scaled(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda x: x * gain)


def multiplied(samples: Column, envelope: Column) -> Column:
    """Samples times an envelope, as long as the shorter of the two."""
    n = F.least(F.size(samples), F.size(envelope))
    return F.zip_with(F.slice(samples, 1, n), F.slice(envelope, 1, n), lambda x, g: x * g)


def peak_db(peak: Column) -> Column:
    """Peak level in dB; silence is -100. Linear interpolation between samples never exceeds them, so the sample peak is
    the peak of any such oversampling."""
    return F.when(peak > 0, 20.0 * F.log10(peak.cast("double"))).otherwise(F.lit(NO_LEVEL))


def true_peak(chunks: DataFrame) -> DataFrame:
    """asset_id, true_peak_db from chunk rows: a map-side maximum of each array, then one row an asset."""
    top = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    return chunks.groupBy("asset_id").agg(peak_db(F.max(top)).alias("true_peak_db"))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.size(samples))
