"""Look-ahead limiter, compressor curve, hard clip."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.functions.levels import gain_of, gain_to_db, half_up
from sonorant.operators.scan import ordered_scan
from sonorant.schemas import PCM_CHUNKS


def release_of(ms: float, rate: float) -> float:
    return 1.0 - math.exp(-1.0 / max(1.0, ms * 0.001 * rate))


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    """The maximum of each window of `width` values: prefix and suffix maxima of blocks, whatever the width."""
    if width <= 1:
        return x.copy()
    n = len(x)
    m = -(-n // width) * width + width
    padded = np.zeros(m, dtype=x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.maximum.accumulate(rows, axis=1).ravel()
    behind = np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[:n], ahead[width - 1 : n + width - 1])


def release_scan(wanted: np.ndarray, release: float, start: float) -> np.ndarray:
    """c[i] = min(d[i], (1 - r) c[i-1] + r d[i]); stretches without reduction, the usual case, are filled at once."""
    out, c, keep, size = np.ones(len(wanted)), start, 1.0 - release, 1024
    for at in range(0, len(wanted), size):
        d = wanted[at : at + size]
        if c >= 1.0 and (d >= 1.0).all():
            continue
        for i, x in enumerate(d.tolist(), at):
            c = min(x, keep * c + release * x)
            out[i] = c
    return out


class _Limiter:
    """Holds back `ahead` samples until it knows what follows them."""

    def __init__(self, ceiling: float, ahead: int, release: float) -> None:
        self.ceiling, self.ahead, self.release = ceiling, ahead, release
        self.rows: list[dict] = []
        self.gain = 1.0

    def _emit(self, row: dict, after: np.ndarray) -> dict:
        x = np.asarray(row["samples"], dtype=np.float32)
        peak = sliding_max(np.abs(np.concatenate([x, after[: self.ahead]])).astype(float), self.ahead + 1)[: len(x)]
        wanted = np.where(peak > self.ceiling, self.ceiling / np.maximum(peak, 1e-30), 1.0)
        g = release_scan(wanted, self.release, self.gain)
        self.gain = float(g[-1]) if len(g) else self.gain
        return {k: row[k] for k in ("asset_id", "channel", "chunk_ix", "start_sample")} | {"samples": (x * g).astype(np.float32), "least_gain": float(g.min()) if len(g) else 1.0}

    def push(self, row: dict) -> list[dict]:
        self.rows.append(row)
        out = []
        while len(self.rows) > 1 and sum(len(r["samples"]) for r in self.rows[1:]) >= self.ahead:
            out.append(self._emit(self.rows[0], np.concatenate([np.asarray(r["samples"], dtype=np.float32) for r in self.rows[1:]])))
            self.rows.pop(0)
        return out

    def close(self) -> list[dict]:
        out = []
        while self.rows:
            after = [np.asarray(r["samples"], dtype=np.float32) for r in self.rows[1:]]
            out.append(self._emit(self.rows[0], np.concatenate(after) if after else np.zeros(0, dtype=np.float32)))
            self.rows.pop(0)
        return out


def limited(chunks: DataFrame, rate: float, ceiling_db: float = -1.0, ahead_ms: float = 5.0, release_ms: float = 50.0) -> DataFrame:
    """Chunk rows after the limiter, with each chunk's least gain. Channels are limited on their own."""
    ceiling, ahead, release = gain_of(ceiling_db), max(0, half_up(ahead_ms * 0.001 * rate)), release_of(release_ms, rate)
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "start_sample", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _Limiter(ceiling, ahead, release), PCM_CHUNKS + ", least_gain float")


def reduction_db(limited_chunks: DataFrame) -> DataFrame:
    """asset_id, limiter_reduction_db: the worst over channels."""
    return limited_chunks.groupBy("asset_id").agg(gain_to_db(F.min("least_gain")).alias("limiter_reduction_db"))
