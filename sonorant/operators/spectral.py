"""Short-time spectra: framing, transforms, reconstruction, spectral measures, resampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sonorant.functions.levels import half_up
from sonorant.operators.scan import ordered_scan
from sonorant.schemas import FRAMES, MAGNITUDES, PCM_CHUNKS


class Stft:
    """Frame geometry: 2^order points, hop = points / divisor, frame f centred on sample f * hop, periodic Hann."""

    def __init__(self, order: int = 10, divisor: int = 4) -> None:
        self.size = 1 << max(1, order)
        self.hop = max(1, self.size // max(1, divisor))
        self.half, self.bins = self.size // 2, self.size // 2 + 1
        self.window = (0.5 * (1.0 - np.cos(2.0 * np.pi * np.arange(self.size) / self.size))).astype(np.float32)

    def frames(self, n: int) -> int:
        return 1 + math.ceil(max(0, n) / self.hop)

    def analyse(self, signal: np.ndarray) -> np.ndarray:
        """Half spectra of a whole signal, one row a frame."""
        n = self.frames(len(signal))
        padded = np.concatenate([np.zeros(self.half), signal, np.zeros(self.size + self.hop)])
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, self.size)[: n * self.hop : self.hop][:n] * self.window, axis=1)

    def synthesise(self, spectra: np.ndarray, length: int) -> np.ndarray:
        """Overlap-add with the window's squares divided out where they are over 1e-8."""
        out, weight = np.zeros(length + 2 * self.size), np.zeros(length + 2 * self.size)
        for f, x in enumerate(np.fft.irfft(spectra, self.size, axis=1)):
            at = f * self.hop
            if at - self.half < length:
                out[at : at + self.size] += x * self.window
                weight[at : at + self.size] += self.window.astype(float) ** 2
        out, weight = out[self.half : self.half + length], weight[self.half : self.half + length]
        return np.where(weight > 1e-8, out / np.maximum(weight, 1e-30), out)


class FrameStream:
    """Spectra of a signal that arrives in pieces; only the samples that later frames need are held."""

    def __init__(self, stft: Stft) -> None:
        self.stft, self.held, self.base, self.next, self.seen = stft, np.zeros(stft.half), -stft.half, 0, 0

    def _take(self, count: int) -> np.ndarray:
        s = self.stft
        if count <= 0:
            return np.zeros((0, s.bins), dtype=complex)
        at = self.next * s.hop - s.half - self.base
        view = np.lib.stride_tricks.sliding_window_view(self.held, s.size)[at : at + (count - 1) * s.hop + 1 : s.hop]
        out = np.fft.rfft(view * s.window, axis=1)
        self.next += count
        drop = self.next * s.hop - s.half - self.base
        self.held, self.base = self.held[drop:], self.base + drop
        return out

    def push(self, x: np.ndarray) -> np.ndarray:
        self.held = np.concatenate([self.held, np.asarray(x, dtype=float)])
        self.seen += len(x)
        return self._take((self.seen - self.stft.half) // self.stft.hop + 1 - self.next if self.seen >= self.stft.half else 0)

    def close(self) -> np.ndarray:
        self.held = np.concatenate([self.held, np.zeros(self.stft.size + self.stft.hop)])
        return self._take(self.stft.frames(self.seen) - self.next)


class OverlapAdd:
    """The signal of spectra that arrive in order; samples leave once no later frame reaches them."""

    def __init__(self, stft: Stft) -> None:
        self.stft, self.base = stft, -stft.half
        self.sum, self.weight = np.zeros(0), np.zeros(0)
        self.next = 0

    def push(self, spectra: np.ndarray) -> np.ndarray:
        s = self.stft
        if not len(spectra):
            return np.zeros(0)
        need = (self.next + len(spectra) - 1) * s.hop - s.half + s.size - self.base
        self.sum = np.concatenate([self.sum, np.zeros(max(0, need - len(self.sum)))])
        self.weight = np.concatenate([self.weight, np.zeros(max(0, need - len(self.weight)))])
        square = s.window.astype(float) ** 2
        for x in np.fft.irfft(spectra, s.size, axis=1):
            at = self.next * s.hop - s.half - self.base
            self.sum[at : at + s.size] += x * s.window
            self.weight[at : at + s.size] += square
            self.next += 1
        return self._leave(self.next * s.hop - s.half - self.base)

    def _leave(self, n: int) -> np.ndarray:
        out, w = self.sum[:n], self.weight[:n]
        out = np.where(w > 1e-8, out / np.maximum(w, 1e-30), out)
        lead = max(0, min(n, -self.base))
        self.sum, self.weight, self.base = self.sum[n:], self.weight[n:], self.base + n
        return out[lead:]

    def close(self) -> np.ndarray:
        return self._leave(len(self.sum))


class Rechunk:
    """Gives a stream of samples the chunk rows of the stream it came from."""

    def __init__(self) -> None:
        self.rows: list[tuple[dict, int]] = []
        self.ready = np.zeros(0)

    def expect(self, row: dict) -> None:
        self.rows.append(({k: row[k] for k in ("asset_id", "channel", "chunk_ix", "start_sample")}, len(row["samples"])))

    def give(self, x: np.ndarray, last: bool = False) -> list[dict]:
        self.ready = np.concatenate([self.ready, x])
        if last:
            self.ready = np.concatenate([self.ready, np.zeros(max(0, sum(n for _, n in self.rows) - len(self.ready)))])
        out = []
        while self.rows and self.rows[0][1] <= len(self.ready):
            head, n = self.rows.pop(0)
            out.append(head | {"samples": self.ready[:n].astype(np.float32)})
            self.ready = self.ready[n:]
        return out


class SpectralScan:
    """Analysis, a function of the frames in order, reconstruction: constant memory whatever the signal's length."""

    def __init__(self, stft: Stft, modify: Callable[[np.ndarray], np.ndarray]) -> None:
        self.stream, self.add, self.modify, self.out = FrameStream(stft), OverlapAdd(stft), modify, Rechunk()

    def push(self, row: dict) -> list[dict]:
        self.out.expect(row)
        return self.out.give(self.add.push(self.modify(self.stream.push(np.asarray(row["samples"])))))

    def close(self) -> list[dict]:
        tail = self.add.push(self.modify(self.stream.close()))
        return self.out.give(np.concatenate([tail, self.add.close()]), last=True)


def transformed(chunks: DataFrame, stft: Stft, make: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Chunk rows after a user's function of spectral frames (rows: frames, columns: bins); state is per (asset, channel)."""
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "start_sample", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: SpectralScan(stft, make()), PCM_CHUNKS)


class _Frames:
    def __init__(self, stft: Stft, as_magnitude: bool) -> None:
        self.stream, self.as_magnitude, self.key, self.next = FrameStream(stft), as_magnitude, {}, 0

    def _rows(self, spectra: np.ndarray) -> list[dict]:
        out = []
        for x in spectra:
            values = {"magnitude": np.abs(x).astype(np.float32)} if self.as_magnitude else {"real": x.real.astype(np.float32), "imag": x.imag.astype(np.float32)}
            out.append(self.key | {"frame_ix": self.next} | values)
            self.next += 1
        return out

    def push(self, row: dict) -> list[dict]:
        self.key = {"asset_id": row["asset_id"], "channel": row["channel"]}
        return self._rows(self.stream.push(np.asarray(row["samples"])))

    def close(self) -> list[dict]:
        return self._rows(self.stream.close())


def frames(chunks: DataFrame, stft: Stft | None = None, magnitudes: bool = False) -> DataFrame:
    """Spectral frames of chunk rows, complex or as magnitudes."""
    s = stft or Stft()
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _Frames(s, magnitudes), MAGNITUDES if magnitudes else FRAMES)


def resample(x: np.ndarray, rate_in: float, rate_out: float, taps: int = 32, first: int = 0, count: int | None = None, total: int | None = None, offset: int = 0) -> np.ndarray:
    """Windowed-sinc resampling with weights that add up to 1, also at the edges.

    first, count: which output samples; offset: where x lies in a signal of `total` samples.
    """
    total = len(x) if total is None else total
    if not total or rate_in <= 0 or rate_out <= 0 or abs(rate_in - rate_out) < 1e-6:
        return np.asarray(x, dtype=np.float32)
    ratio = rate_out / rate_in
    count = max(1, half_up(total * ratio)) - first if count is None else count
    half, cutoff = max(2, taps // 2), min(1.0, ratio)
    k = np.arange(-half + 1, half + 1)
    out = np.zeros(count, dtype=np.float32)
    for at in range(0, count, 16_384):
        position = (first + np.arange(at, min(count, at + 16_384))) / ratio
        centre = np.floor(position).astype(np.int64)
        frac = (position - centre)[:, None]
        index = centre[:, None] + k
        inside = (index >= 0) & (index < total)
        weight = np.where(inside, np.sinc((k - frac) * cutoff) * 0.5 * (1.0 + np.cos(np.pi * (k - frac) / half)), 0.0)
        value = np.asarray(x, dtype=float)[np.clip(index - offset, 0, len(x) - 1)]
        whole = weight.sum(axis=1)
        out[at : at + len(position)] = np.where(whole > 1e-9, (value * weight).sum(axis=1) / np.where(whole > 1e-9, whole, 1.0), 0.0)
    return out


def resampled(signals: DataFrame, rate_in: float, rate_out: float, taps: int = 32) -> DataFrame:
    """Rows of whole short signals (any key columns, samples) at another rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(samples=[resample(np.asarray(s), rate_in, rate_out, taps) for s in b["samples"]])

    return signals.mapInPandas(run, signals.schema)


class _Resampler:
    """Chunk rows at another rate; holds the samples that the next outputs need."""

    def __init__(self, rate_in: float, rate_out: float, taps: int, size: int) -> None:
        self.rates, self.taps, self.size, self.reach = (rate_in, rate_out), taps, size, max(2, taps // 2) + 1
        self.held, self.base, self.done, self.ix, self.key = np.zeros(0, dtype=np.float32), 0, 0, 0, {}

    def _make(self, count: int, total: int) -> list[dict]:
        if count <= 0:
            return []
        x = resample(self.held, *self.rates, self.taps, self.done, count, total, self.base)
        row = self.key | {"chunk_ix": self.ix, "start_sample": self.done, "samples": x}
        self.done, self.ix = self.done + count, self.ix + 1
        drop = max(0, int(self.done * self.rates[0] / self.rates[1]) - self.reach - self.base)
        self.held, self.base = self.held[drop:], self.base + drop
        return [row]

    def push(self, row: dict) -> list[dict]:
        self.key = {"asset_id": row["asset_id"], "channel": row["channel"]}
        self.held = np.concatenate([self.held, np.asarray(row["samples"], dtype=np.float32)])
        ready = int((self.base + len(self.held) - self.reach) * self.rates[1] / self.rates[0]) - self.done
        return self._make(ready, 1 << 62) if ready >= self.size else []

    def close(self) -> list[dict]:
        total = self.base + len(self.held)
        return self._make(max(1, half_up(total * self.rates[1] / self.rates[0])) - self.done, total) if total else []


def resampled_chunks(chunks: DataFrame, rate_in: float, rate_out: float, taps: int = 32, size: int = 16_384) -> DataFrame:
    """Chunk rows at another rate, of any length."""
    if abs(rate_in - rate_out) < 1e-6:
        return chunks
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _Resampler(rate_in, rate_out, taps, size), PCM_CHUNKS)
