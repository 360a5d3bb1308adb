"""Generated signals and chunk rows for tests."""

from __future__ import annotations

import numpy as np

from sonorant.schemas import PCM_CHUNKS


def chunks(spark, signals: dict[str, list[np.ndarray]], size: int = 4096):
    """Chunk rows of recordings: name -> channels."""
    rows = [
        (name, c, i, at, [float(v) for v in x[at : at + size]])
        for name, channels in signals.items() for c, x in enumerate(channels) for i, at in enumerate(range(0, len(x), size))
    ]
    return spark.createDataFrame(rows, PCM_CHUNKS)


def joined(df, name: str, channel: int = 0) -> np.ndarray:
    """The samples of one channel, in order."""
    rows = df.where(f"asset_id = '{name}' AND channel = {channel}").orderBy("chunk_ix").select("samples").collect()
    return np.concatenate([np.asarray(r["samples"]) for r in rows]) if rows else np.zeros(0)


def tones(rate: int, n: int, start: float, end: float) -> np.ndarray:
    """Three tones between two times, silence elsewhere."""
    t = np.arange(n) / rate
    x = 0.30 * np.sin(2 * np.pi * 180 * t) + 0.18 * np.sin(2 * np.pi * 360 * t) + 0.10 * np.sin(2 * np.pi * 900 * t)
    return np.where((t >= start) & (t < end), x, 0.0)


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x))))
