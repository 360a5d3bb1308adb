"""Voice activity, spectral denoiser and non-speech gate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.functions.levels import frame_coefficient, gain_of, half_up
from sonorant.operators.scan import ordered_scan
from sonorant.operators.signal import mixdown_chunks, multiplied
from sonorant.operators.spectral import FrameStream, SpectralScan, Stft
from sonorant.schemas import PCM_CHUNKS, VAD_FRAMES


class VoiceActivity:
    """Speech probability of frames in order, with a noise floor by minimum statistics over frames without speech.

    The first frame seeds the floor and has probability 0; frames at 0.5 or more leave the statistics as they are.
    """

    BIAS, SMOOTH, BLOCK, TINY = 5.0, 0.5, 48, 1e-12

    def __init__(self, sensitivity: float = 0.5) -> None:
        self.sensitivity, self.noise = min(1.0, max(0.0, sensitivity)), None

    def step(self, magnitude: np.ndarray) -> float:
        power = magnitude.astype(float) ** 2
        held = np.maximum(power, 1e-9)
        if self.noise is None:
            self.smooth, self.least, self.before, self.count = held.copy(), held.copy(), held.copy(), 0
            self.noise = np.sqrt(self.BIAS * held)
            return 0.0
        snr = 10.0 * np.log10((power.sum() + self.TINY) / ((self.noise**2).sum() + self.TINY))
        flat = np.exp(np.log(power + self.TINY).mean()) / (power.mean() + self.TINY)
        tonal = 0.35 + 0.65 * min(1.0, max(0.0, (0.7 - flat) / 0.5))
        p = min(1.0, max(0.0, tonal / (1.0 + np.exp(-(snr - (9.0 - 6.0 * self.sensitivity)) / 4.0))))
        if p < 0.5:
            self.smooth = self.smooth + self.SMOOTH * (held - self.smooth)
            self.least = np.minimum(self.least, self.smooth)
            self.count += 1
            if self.count >= self.BLOCK:
                self.before, self.least, self.count = self.least, self.smooth.copy(), 0
        self.noise = np.sqrt(self.BIAS * np.maximum(np.minimum(self.least, self.before), 1e-9))
        return float(p)


class _Activity:
    def __init__(self, sensitivity: float) -> None:
        self.vad = VoiceActivity(sensitivity)

    def push(self, row: dict) -> list[dict]:
        p = self.vad.step(np.asarray(row["magnitude"]))
        return [{k: row[k] for k in ("asset_id", "channel", "frame_ix")} | {"probability": p, "noise_magnitude": self.vad.noise.astype(np.float32)}]

    def close(self) -> list[dict]:
        return []


def voice_activity(magnitudes: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """asset_id, channel, frame_ix, probability, noise_magnitude for magnitude frames."""
    return ordered_scan(magnitudes, ["asset_id", "channel"], ["frame_ix"], lambda: _Activity(sensitivity), VAD_FRAMES)


@dataclass(frozen=True)
class DenoiseSettings:
    reduction_db: float = 12.0
    floor_db: float = -60.0
    sensitivity: float = 0.5
    speech_protection: float = 0.9
    smoothing: float = 0.6
    over_subtraction: float = 1.0
    order: int = 10
    divisor: int = 4


class Denoiser:
    """Decision-directed Wiener gains, frame by frame, limited in depth and held off speech."""

    NON_SPEECH = 0.35

    def __init__(self, s: DenoiseSettings) -> None:
        self.s, self.vad = s, VoiceActivity(s.sensitivity)
        self.least = max(gain_of(-abs(s.reduction_db)), gain_of(s.floor_db))
        self.keep = min(0.99, max(0.0, s.smoothing))
        self.protect = min(1.0, max(0.0, s.speech_protection))
        self.power, self.gain, self.frames, self.quiet = None, None, 0, 0

    def __call__(self, spectra: np.ndarray) -> np.ndarray:
        out = spectra.copy()
        for i, x in enumerate(spectra):
            m = np.abs(x)
            p = self.vad.step(m)
            power = m**2
            if self.power is None:
                self.power, self.gain = np.zeros_like(power), np.ones_like(power)
            noise = np.maximum(self.vad.noise**2 * self.s.over_subtraction, 1e-12)
            post = power / noise
            prior = np.maximum(0.0, 0.98 * self.gain**2 * self.power / noise + 0.02 * np.maximum(post - 1.0, 0.0))
            g = prior / (prior + 1.0)
            g = g + (1.0 - g) * self.protect * p * post / (post + 1.0)
            wide = np.concatenate([g[:1], g, g[-1:]])
            g = 0.25 * wide[:-2] + 0.5 * g + 0.25 * wide[2:]
            g = self.gain * self.keep + g * (1.0 - self.keep)
            self.gain, self.power = np.minimum(1.0, np.maximum(g, self.least)), power
            out[i] = x * self.gain
            self.frames += 1
            self.quiet += p < self.NON_SPEECH
        return out


class _DenoiseScan:
    """Chunk rows carry the counts of frames so far, so that one pass gives audio and report."""

    def __init__(self, s: DenoiseSettings) -> None:
        self.denoiser = Denoiser(s)
        self.scan = SpectralScan(Stft(s.order, s.divisor), self.denoiser)

    def _with(self, rows: list[dict]) -> list[dict]:
        d = self.denoiser
        return [r | {"frames": d.frames, "quiet_frames": d.quiet} for r in rows]

    def push(self, row: dict) -> list[dict]:
        return self._with(self.scan.push(row))

    def close(self) -> list[dict]:
        return self._with(self.scan.close())


def denoised(chunks: DataFrame, settings: DenoiseSettings | None = None) -> DataFrame:
    """Denoised chunk rows, with frames and quiet_frames counted up to each (the last chunk has the totals)."""
    s = settings or DenoiseSettings()
    return ordered_scan(chunks.select("asset_id", "channel", "chunk_ix", "start_sample", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _DenoiseScan(s), PCM_CHUNKS + ", frames bigint, quiet_frames bigint")


def non_speech_ratio(denoised_chunks: DataFrame) -> DataFrame:
    """asset_id, non_speech_ratio, denoised_channels: the mean over channels of each one's share of quiet frames."""
    by = denoised_chunks.groupBy("asset_id", "channel").agg((F.max("quiet_frames") / F.greatest(F.max("frames"), F.lit(1))).alias("ratio"))
    return by.groupBy("asset_id").agg(F.avg("ratio").alias("non_speech_ratio"), F.count(F.lit(1)).cast("int").alias("denoised_channels"))


@dataclass(frozen=True)
class GateSettings:
    sensitivity: float = 0.5
    open_threshold: float = 0.35
    attack_ms: float = 30.0
    release_ms: float = 150.0
    hold_ms: float = 150.0
    floor_db: float = -60.0
    order: int = 10
    divisor: int = 4


def hold_frames(hold_ms: float, hop: int, rate: float) -> int:
    return max(0, half_up(hold_ms * 0.001 / (hop / rate)))


class _GateScan:
    """Envelope chunk rows of a mono signal: frames, activity, hold, followers, interpolation."""

    def __init__(self, s: GateSettings, rate: float) -> None:
        self.stft = Stft(s.order, s.divisor)
        self.stream, self.vad, self.s = FrameStream(self.stft), VoiceActivity(s.sensitivity), s
        self.floor = min(1.0, max(0.0, gain_of(s.floor_db)))
        seconds = self.stft.hop / rate
        self.up, self.down = frame_coefficient(seconds, s.attack_ms), frame_coefficient(seconds, s.release_ms)
        self.hold, self.left, self.level = hold_frames(s.hold_ms, self.stft.hop, rate), 0, self.floor
        self.levels: list[float] = []
        self.first = 0  # the frame of levels[0]
        self.rows: list[dict] = []
        self.frames = self.speech = 0

    def _follow(self, spectra: np.ndarray) -> None:
        for x in spectra:
            hit = self.vad.step(np.abs(x)) >= self.s.open_threshold
            self.left = self.hold if hit else self.left
            opened = self.left > 0
            self.left -= opened
            target = 1.0 if opened else self.floor
            self.level += (self.up if target > self.level else self.down) * (target - self.level)
            self.levels.append(self.level)
            self.frames += 1
            self.speech += opened

    def _emit(self, last: bool) -> list[dict]:
        out, hop = [], self.stft.hop
        while self.rows:
            row = self.rows[0]
            s = row["start_sample"] + np.arange(len(row["samples"]))
            f = s // hop
            if len(s) and not last and f[-1] + 1 >= self.first + len(self.levels):
                break
            at = np.asarray(self.levels)
            a, b = (at[np.minimum(f + d - self.first, len(at) - 1)] for d in (0, 1))
            gain = (a + (b - a) * (s - f * hop) / hop).astype(np.float32)
            out.append({k: row[k] for k in ("asset_id", "channel", "chunk_ix", "start_sample")} | {"samples": gain, "frames": self.frames, "speech_frames": self.speech})
            self.rows.pop(0)
            drop = int(f[-1]) - self.first if len(f) else 0
            self.levels, self.first = self.levels[drop:], self.first + drop
        return out

    def push(self, row: dict) -> list[dict]:
        self.rows.append(row)
        self._follow(self.stream.push(np.asarray(row["samples"])))
        return self._emit(False)

    def close(self) -> list[dict]:
        self._follow(self.stream.close())
        return self._emit(True)


def gate_envelope(mono: DataFrame, rate: float, settings: GateSettings | None = None) -> DataFrame:
    """Gains as chunk rows of a mono signal, with frames and speech_frames counted up to each."""
    s = settings or GateSettings()
    return ordered_scan(mono.select("asset_id", "channel", "chunk_ix", "start_sample", "samples"), ["asset_id", "channel"], ["chunk_ix"], lambda: _GateScan(s, rate), PCM_CHUNKS + ", frames bigint, speech_frames bigint")


def silenced(chunks: DataFrame, rate: float, settings: GateSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """Gated chunk rows and the envelope: one envelope, from the mixdown, for all channels."""
    envelope = gate_envelope(mixdown_chunks(chunks), rate, settings)
    gains = envelope.select("asset_id", "chunk_ix", F.col("samples").alias("_gain"))
    out = chunks.join(gains, ["asset_id", "chunk_ix"]).select("asset_id", "channel", "chunk_ix", "start_sample", multiplied(F.col("samples"), F.col("_gain")).alias("samples"))
    return out, envelope


def silenced_ratio(envelope: DataFrame) -> DataFrame:
    """asset_id, silenced_ratio (samples with a gain under 0.5), speech_ratio (frames with the gate open)."""
    low = F.size(F.filter("samples", lambda g: g < 0.5))
    return envelope.groupBy("asset_id").agg((F.sum(low) / F.greatest(F.sum(F.size("samples")), F.lit(1))).alias("silenced_ratio"), (F.max("speech_frames") / F.greatest(F.max("frames"), F.lit(1))).alias("speech_ratio"))
