"""Level, window and time functions, as columns and, where plans need literals, as Python scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-12


def gain_to_db(g: Column) -> Column:
    """Linear gain to dB; anything below 1e-12 is -240 dB."""
    return 20.0 * F.log10(F.greatest(g.cast("double"), F.lit(_TINY)))


def db_to_gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db.cast("double") * 0.05)


def gain_of(db: float) -> float:
    return 10.0 ** (db * 0.05)


def db_of(gain: float) -> float:
    return 20.0 * math.log10(max(gain, _TINY))


def block_loudness(mean_square: Column) -> Column:
    """Loudness of a block of K-weighted samples from its mean square."""
    return F.lit(-0.691) + 10.0 * F.log10(mean_square + F.lit(_TINY))


def smoothing_of(ms: float, rate: float) -> float:
    return math.exp(-1.0 / (ms * 0.001 * rate))


def frame_coefficient(seconds: float, ms: float) -> float:
    """Attack or release step of a frame-rate follower; time constants under 1 ms count as 1 ms."""
    return 1.0 - math.exp(-seconds / max(0.001, ms * 0.001))


def ms_to_samples(ms: Column, rate: Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", ms.cast("bigint") * rate.cast("bigint"), F.lit(1000).cast("bigint"))


def clamp_index(v: Column, size: Column) -> Column:
    """v held within [0, size]."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(v, size))


def half_up(x: float) -> int:
    """Round half away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)
