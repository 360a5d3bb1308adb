"""Second-order filters over chunk rows, in blocks instead of sample by sample."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from sonorant.operators.scan import ordered_scan
from sonorant.schemas import PCM_CHUNKS


@dataclass(frozen=True)
class Coefficients:
    b0: float
    b1: float
    b2: float
    a1: float
    a2: float


class Biquad:
    """A linear filter with two states, advanced a block at a time: y = T x + O s, s' = A^n s + R x.

    The output is rounded to float, the state is double.
    """

    BLOCK = 128

    def __init__(self, c: Coefficients) -> None:
        a = np.array([[-c.a1, 1.0], [-c.a2, 0.0]])
        b = np.array([c.b1 - c.a1 * c.b0, c.b2 - c.a2 * c.b0])
        powers = [np.eye(2)]
        for _ in range(self.BLOCK):
            powers.append(a @ powers[-1])
        impulse = np.array([c.b0, *[(p @ b)[0] for p in powers[: self.BLOCK - 1]]])
        lag = np.subtract.outer(np.arange(self.BLOCK), np.arange(self.BLOCK))
        self.toeplitz = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.free = np.array([p[0] for p in powers[: self.BLOCK]])
        self.reach = np.stack([p @ b for p in powers[: self.BLOCK]])  # effect on the state of an input so many steps ago
        self.powers = powers
        self.state = np.zeros(2)

    def process(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        out = np.empty(len(x))
        whole = len(x) // self.BLOCK * self.BLOCK
        if whole:
            rows = x[:whole].reshape(-1, self.BLOCK)
            driven, pushed = rows @ self.toeplitz.T, rows @ self.reach[::-1]
            step, s, states = self.powers[self.BLOCK], self.state, np.empty((len(rows), 2))
            for i in range(len(rows)):
                states[i] = s
                s = step @ s + pushed[i]
            self.state = s
            out[:whole] = (driven + states @ self.free.T).ravel()
        if n := len(x) - whole:
            tail = x[whole:]
            out[whole:] = self.toeplitz[:n, :n] @ tail + self.free[:n] @ self.state
            self.state = self.powers[n] @ self.state + tail @ self.reach[:n][::-1]
        return out.astype(np.float32)


def high_pass(rate: float, cutoff: float = 80.0, q: float = math.sqrt(0.5)) -> Coefficients:
    """The cookbook's high-pass; the cutoff is held within 1 Hz and 0.999 of Nyquist. Coefficients are floats."""
    f = min(max(cutoff, 1.0), rate * 0.5 * 0.999)
    w = 2.0 * math.pi * f / rate
    alpha = math.sin(w) / (2.0 * max(q, 1e-4))
    a0, c = 1.0 + alpha, math.cos(w)
    values = ((1.0 + c) * 0.5 / a0, -(1.0 + c) / a0, (1.0 + c) * 0.5 / a0, -2.0 * c / a0, (1.0 - alpha) / a0)
    return Coefficients(*(float(np.float32(v)) for v in values))


def peaking(rate: float, frequency: float, q: float, gain_db: float) -> Coefficients:
    """The cookbook's peaking equaliser."""
    a, w = 10.0 ** (gain_db / 40.0), 2.0 * math.pi * frequency / rate
    alpha, c = math.sin(w) / (2.0 * q), math.cos(w)
    a0 = 1.0 + alpha / a
    return Coefficients((1.0 + alpha * a) / a0, -2.0 * c / a0, (1.0 - alpha * a) / a0, -2.0 * c / a0, (1.0 - alpha / a) / a0)


class _ChunkFilter:
    def __init__(self, stages: list[Biquad]) -> None:
        self.stages = stages

    def push(self, row: dict) -> list[dict]:
        x = np.asarray(row["samples"], dtype=np.float32)
        for s in self.stages:
            x = s.process(x)
        return [row | {"samples": x}]

    def close(self) -> list[dict]:
        return []


def filtered(chunks: DataFrame, stages: Callable[[], list[Biquad]]) -> DataFrame:
    """Chunk rows after a chain of filters; every (asset, channel) starts from rest."""
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "start_sample", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _ChunkFilter(stages()), PCM_CHUNKS)
