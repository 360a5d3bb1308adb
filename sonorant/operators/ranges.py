"""Sample ranges: from words, clamped, merged, joined with chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorant.functions.dictionary import Dictionary
from sonorant.functions.levels import clamp_index, ms_to_samples
from sonorant.operators.match import listed


def merge(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end", total: str | None = None) -> DataFrame:
    """Merged half-open ranges for each key; touching ones join. Empty or inverted ranges go.

    total: a column that clamps ranges to [0, total]. A running maximum of ends before each row gives islands, so one
    shuffle by key and one sort serve the whole merge.
    """
    r = ranges
    if total is not None:
        r = r.withColumns({start: clamp_index(F.col(start), F.col(total)), end: clamp_index(F.col(end), F.col(total))})
    r = r.where(F.col(end) > F.col(start)).select(*keys, start, end)
    order = Window.partitionBy(*keys).orderBy(start)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    r = r.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def from_words(words: DataFrame, dictionary: Dictionary, margin_ms: int = 0, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Merged sample ranges of listed words (start_ms, end_ms, sample_rate, num_samples) padded by a margin."""
    hit = listed(words, dictionary)
    rate = F.col("sample_rate")
    margin = ms_to_samples(F.lit(margin_ms), rate)  # times become samples each on its own
    r = hit.select(*keys, "num_samples", (ms_to_samples(F.col("start_ms"), rate) - margin).alias("start"), (ms_to_samples(F.col("end_ms"), rate) + margin).alias("end"))
    return merge(r, list(keys), total="num_samples")


def union_merge(manual: DataFrame, found: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """Manual and detected ranges, merged."""
    return merge(manual.unionByName(found), keys, total=total)


def overlap_join(chunks: DataFrame, ranges: DataFrame, keys: list[str], width: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of chunks [lo, hi) and ranges [start, end) of one key that overlap, each once.

    Both sides are cut into bins of `width` and meet in an equi-join on (keys, bin), which a long recording spreads over
    many tasks; a pair counts in the first bin that both have.
    """

    def binned(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        df = df.where(F.col(b) > F.col(a)).withColumn(f"_{name}", F.floor(F.col(a) / width))
        return df.withColumn("_bin", F.explode(F.sequence(F.col(f"_{name}"), F.floor((F.col(b) - 1) / width))))

    left, right = binned(chunks, lo, hi, "c"), binned(ranges, "start", "end", "r")
    on = [*keys, "_bin"]
    pairs = left.join(right, on).where((F.col("_bin") == F.greatest("_c", "_r")) & (F.col("start") < F.col(hi)) & (F.col("end") > F.col(lo)))
    return pairs.drop("_bin", "_c", "_r")
