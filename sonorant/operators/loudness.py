"""Gated loudness: K-weighting, sliding blocks, two gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorant.functions.levels import block_loudness, half_up
from sonorant.operators.filters import Biquad, Coefficients, filtered
from sonorant.schemas import NO_LEVEL

ABSOLUTE, RELATIVE = -70.0, -10.0

# The two K-weighting stages as (frequency, quality, gain dB, gain exponent).
SHELF = (1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416)
LOW_CUT = (38.13547087602444, 0.5003270373238773)


def high_shelf(rate: float) -> Coefficients:
    f, q, gain, power = SHELF
    k, v = math.tan(math.pi * f / rate), 10.0 ** (gain / 20.0)
    b, norm = v**power, 1.0 + k / q + k * k
    return Coefficients((v + b * k / q + k * k) / norm, 2.0 * (k * k - v) / norm, (v - b * k / q + k * k) / norm, 2.0 * (k * k - 1.0) / norm, (1.0 - k / q + k * k) / norm)


def low_cut(rate: float, published: bool = False) -> Coefficients:
    """The second stage; its numerator is divided by a0 as well, which reads 0.04 dB less than the published table."""
    f, q = LOW_CUT
    k = math.tan(math.pi * f / rate)
    norm = 1.0 + k / q + k * k
    b = 1.0 if published else 1.0 / norm
    return Coefficients(b, -2.0 * b, b, 2.0 * (k * k - 1.0) / norm, (1.0 - k / q + k * k) / norm)


def k_weighted(chunks: DataFrame, rate: float) -> DataFrame:
    """Chunk rows after both stages; each stage's output is rounded to float."""
    return filtered(chunks, lambda: [Biquad(high_shelf(rate)), Biquad(low_cut(rate))])


def chunk_hop_sums(chunks: DataFrame, hop: int, block: int | None = None) -> DataFrame:
    """asset_id, hop, energy, n, head_energy, head_n: sums of squares over all channels in buckets of `hop` samples and
    in each bucket's first block mod hop samples, with the number of samples a channel has there.

    Arrays are cut at bucket borders, so rows are buckets, not samples.
    """
    rest = (4 * hop if block is None else block) % hop
    first, last = F.floor(F.col("start_sample") / hop), F.floor((F.col("start_sample") + F.size("samples") - 1) / hop)
    cut = chunks.where(F.size("samples") > 0).select("asset_id", "channel", "start_sample", "samples", F.explode(F.sequence(first, last)).alias("hop"))
    lo = F.greatest(F.col("hop") * hop - F.col("start_sample"), F.lit(0))

    def part(size: int) -> tuple[Column, Column]:
        n = F.greatest(F.least(F.col("hop") * hop + size - F.col("start_sample"), F.size("samples")) - lo, F.lit(0))
        return F.aggregate(F.slice("samples", (lo + 1).cast("int"), n.cast("int")), F.lit(0.0), lambda a, x: a + x.cast("double") * x), n

    (energy, n), (head, head_n) = part(hop), part(rest)
    by = cut.select("asset_id", "channel", "hop", energy.alias("energy"), n.alias("n"), head.alias("head_energy"), head_n.alias("head_n"))
    one = F.col("channel") == 0
    return by.groupBy("asset_id", "hop").agg(
        F.sum("energy").alias("energy"), F.sum(F.when(one, F.col("n")).otherwise(0)).alias("n"), F.sum("head_energy").alias("head_energy"), F.sum(F.when(one, F.col("head_n")).otherwise(0)).alias("head_n")
    )


def blocks(hops: DataFrame, hop: int, block: int | None = None, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Mean squares of complete blocks (four hops by default) at every hop. The sum is over channels, the mean over one's length."""
    block = 4 * hop if block is None else block
    whole = block // hop
    order = Window.partitionBy(*keys).orderBy("hop")
    full = order.rowsBetween(0, whole - 1)
    energy, n = F.sum("energy").over(full), F.sum("n").over(full)
    if block % hop:
        energy, n = energy + F.lead("head_energy", whole).over(order), n + F.lead("head_n", whole).over(order)
    b = hops.withColumns({"_e": energy, "_n": n})
    return b.where(F.col("_n") == block).select(*keys, F.col("hop").alias("block"), (F.col("_e") / block).alias("mean_square"))


def gated(block_rows: DataFrame, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Integrated loudness for each key from block mean squares; keys without a block over the gates read -100."""
    b = block_rows.withColumn("loudness", block_loudness(F.col("mean_square")))
    w = Window.partitionBy(*keys)
    level = F.avg(F.when(F.col("loudness") >= ABSOLUTE, F.col("mean_square"))).over(w)
    b = b.withColumn("_least", F.lit(-0.691) + 10.0 * F.log10(level) + RELATIVE)
    kept = (F.col("loudness") >= ABSOLUTE) & (F.col("loudness") >= F.col("_least"))
    final = F.avg(F.when(kept, F.col("mean_square")))
    return b.groupBy(*keys).agg(F.coalesce(F.lit(-0.691) + 10.0 * F.log10(final), F.lit(NO_LEVEL)).alias("lufs"))


def integrated(chunks: DataFrame, rate: float) -> DataFrame:
    """asset_id, lufs of chunk rows; silence and clips under 400 ms read -100."""
    hop, block = half_up(0.1 * rate), half_up(0.4 * rate)  # each rounded on its own
    measured = gated(blocks(chunk_hop_sums(k_weighted(chunks, rate), hop, block), hop, block))
    assets = chunks.select("asset_id").distinct()
    return assets.join(measured, "asset_id", "left").select("asset_id", F.coalesce("lufs", F.lit(NO_LEVEL)).alias("lufs"))


def mastering_gain_db(measured: Column, target: float = -16.0, most: float = 24.0) -> Column:
    """The gain that reaches the target, within plus or minus `most` dB."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(target) - measured))
