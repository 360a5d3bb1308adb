"""Streaming dynamics: high-pass, gate, compressor, equaliser, gain, clip, with state carried from block to block.

Blocks of a stream carry a sequence number. A stateful processor keeps the state of each stream_id and, as blocks may
come out of order, those that are ahead of their turn; a block that came already is dropped. The same code runs over a
table in a batch, so both give the same samples however a signal is cut into blocks. A block that more than `most_waiting`
others wait for, or that does not come for `patience_ms` while others wait, counts as lost: the chain goes on with the
next one that is there, and the lost one, should it come later, is dropped. Patience needs timers, with which Spark runs
batches without data for as long as a query runs, so that one with availableNow would not end; it is off by default.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonorant.functions.levels import gain_of, smoothing_of
from sonorant.operators.filters import Biquad, high_pass, peaking
from sonorant.operators.scan import ordered_scan
from sonorant.schemas import STREAM_BLOCKS

# Time constants in ms, levels in dB, equaliser bands as (Hz, Q, dB).
GATE_MS, COMPRESSOR_MS = (3.0, 150.0), (10.0, 100.0)
COMPRESSOR_DB, CEILING_DB = -18.0, -1.0
BANDS = ((300.0, 0.8, -3.0), (3000.0, 0.8, 2.0))
BOUNDS = {"gate_threshold_db": (-80.0, -20.0), "ratio": (1.0, 8.0), "output_gain_db": (-12.0, 12.0)}


@dataclass(frozen=True)
class ChainSettings:
    hpf: bool = True
    gate: bool = True
    compressor: bool = True
    eq: bool = True
    limiter: bool = True
    gate_threshold_db: float = -45.0
    ratio: float = 3.0
    output_gain_db: float = 0.0

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            object.__setattr__(self, name, min(high, max(low, float(getattr(self, name)))))

    def to_json(self) -> str:
        return json.dumps({"kind": "chain"} | asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ChainSettings:
        """Settings saved by to_json; anything else gives the defaults."""
        try:
            held = json.loads(text)
        except ValueError:
            return cls()
        if not isinstance(held, dict) or held.pop("kind", None) != "chain":
            return cls()
        return cls(**{k: v for k, v in held.items() if k in cls.__dataclass_fields__})


class Chain:
    """The chain for one stream, mono or stereo."""

    STATE = 3 + 2 * 3 * 2  # gate envelope, gate gain, compressor envelope; two states of three filters of two channels

    def __init__(self, s: ChainSettings, rate: float) -> None:
        self.s, self.rate = s, rate
        self.filters = [[Biquad(high_pass(rate)), *[Biquad(peaking(rate, *b)) for b in BANDS]] for _ in range(2)]
        self.gate_env, self.gate_gain, self.comp_env = 0.0, 1.0, 0.0

    def save(self) -> np.ndarray:
        return np.concatenate([[self.gate_env, self.gate_gain, self.comp_env], *[f.state for c in self.filters for f in c]])

    def load(self, state: np.ndarray) -> None:
        self.gate_env, self.gate_gain, self.comp_env = map(float, state[:3])
        for i, f in enumerate(f for c in self.filters for f in c):
            f.state = np.asarray(state[3 + 2 * i : 5 + 2 * i], dtype=float)

    def process(self, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """One block. The detectors are linked: they see the louder channel."""
        s = self.s
        channels = [np.asarray(x, dtype=np.float32).astype(float) for x in (left, right) if x is not None]
        if not len(channels[0]):
            return left, right
        if s.hpf:
            channels = [self.filters[i][0].process(x).astype(float) for i, x in enumerate(channels)]
        level = np.abs(np.stack(channels)).max(axis=0)
        gate, gain = self._dynamics(level)
        channels = [x * gate * gain for x in channels]
        if s.eq:
            for i, x in enumerate(channels):
                for f in self.filters[i][1:]:
                    x = f.process(x).astype(float)
                channels[i] = x
        channels = [x * gain_of(s.output_gain_db) for x in channels]
        if s.limiter:
            c = gain_of(CEILING_DB)
            channels = [np.clip(x, -c, c) for x in channels]
        out = [x.astype(np.float32) for x in channels]
        return out[0], out[1] if right is not None else None

    def _dynamics(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gate and compressor gains; the followers depend on themselves, so they run sample by sample."""
        s, rate = self.s, self.rate
        (ga, gr), (ca, cr) = ((smoothing_of(a, rate), smoothing_of(r, rate)) for a, r in (GATE_MS, COMPRESSOR_MS))
        threshold, slope = gain_of(s.gate_threshold_db), 1.0 / max(1.0, s.ratio) - 1.0
        env, gain, comp = self.gate_env, self.gate_gain, self.comp_env
        gates, gains = [], []
        for x in level.tolist():
            k = ga if x > env else gr
            env = k * env + (1.0 - k) * x
            target = 1.0 if not s.gate or env >= threshold else 0.0
            k = ga if target > gain else gr
            gain = k * gain + (1.0 - k) * target
            y = x * gain
            k = ca if y > comp else cr
            comp = k * comp + (1.0 - k) * y
            gates.append(gain)
            over = 20.0 * math.log10(comp) - COMPRESSOR_DB if s.compressor and comp > 0.0 else 0.0
            gains.append(10.0 ** (over * slope * 0.05) if over > 0.0 else 1.0)
        self.gate_env, self.gate_gain, self.comp_env = env, gain, comp
        return np.array(gates), np.array(gains)


class _BlockScan:
    def __init__(self, s: ChainSettings, rate: float) -> None:
        self.chain, self.last = Chain(s, rate), None

    def push(self, row: dict) -> list[dict]:
        if row["block_seq"] == self.last:
            return []
        self.last = row["block_seq"]
        left, right = self.chain.process(np.asarray(row["left"]), None if row["right"] is None else np.asarray(row["right"]))
        return [{"stream_id": row["stream_id"], "block_seq": row["block_seq"], "left": left, "right": right}]

    def close(self) -> list[dict]:
        return []


def batch(blocks: DataFrame, rate: float, settings: ChainSettings | None = None) -> DataFrame:
    """The chain over a table of blocks."""
    s = settings or ChainSettings()
    return ordered_scan(blocks.select("stream_id", "block_seq", "left", "right"), ["stream_id"], ["block_seq"], lambda: _BlockScan(s, rate), STREAM_BLOCKS)


class ChainProcessor(StatefulProcessor):
    """State for each stream: the chain's numbers, the next block's sequence number, blocks that wait for their turn."""

    def __init__(self, settings: ChainSettings, rate: float, first: int = 0, patience_ms: int | None = None, most_waiting: int = 256) -> None:
        self.settings, self.rate, self.first, self.patience_ms, self.most_waiting = settings, rate, first, patience_ms, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "next bigint, numbers array<double>")
        self.timer = handle.getValueState("timer", "due bigint, next bigint")
        self.waiting = handle.getMapState("waiting", "block_seq bigint", "left array<float>, right array<float>")

    def _resume(self) -> tuple[Chain, int]:
        chain, turn = Chain(self.settings, self.rate), self.first
        if self.state.exists():
            turn, numbers = self.state.get()
            chain.load(np.asarray(numbers))
        return chain, turn

    def _run(self, name: str, chain: Chain, turn: int, held: dict, skip: bool) -> tuple[int, list[tuple]]:
        """Blocks from the turn on, as far as they are there; with skip, lost ones before the next are passed over."""
        out = []
        if skip and held and turn not in held:
            turn = min(held)
        while True:
            while turn in held:
                left, right = held.pop(turn)
                left, right = chain.process(np.asarray(left, dtype=np.float32), None if right is None else np.asarray(right, dtype=np.float32))
                out.append((name, turn, left, right))
                turn += 1
            if len(held) <= self.most_waiting:
                return turn, out
            turn = min(held)

    def _now(self, timers) -> int:
        return 0 if self.patience_ms is None else timers.getCurrentProcessingTimeInMs()

    def _finish(self, chain: Chain, turn: int, held: dict, before: set[int], now: int) -> None:
        for seq in before - set(held):
            self.waiting.removeKey((seq,))
        for seq in set(held) - before:
            left, right = held[seq]
            self.waiting.updateValue((seq,), ([float(x) for x in left], None if right is None else [float(x) for x in right]))
        self.state.update((turn, [float(x) for x in chain.save()]))
        if self.patience_ms is None:
            return
        due = self.timer.get()[0] if self.timer.exists() else 0
        if held and due <= now:  # one timer at a time; when it fires, what has waited since is passed over
            self.timer.update((now + self.patience_ms, turn))
            self.handle.registerTimer(now + self.patience_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chain, turn = self._resume()
        held = {int(k[0]): v for k, v in self.waiting.iterator()}
        before = set(held)
        for b in rows:
            for seq, left, right in zip(b["block_seq"], b["left"], b["right"], strict=True):
                if seq >= turn:
                    held.setdefault(int(seq), (left, right))
        turn, out = self._run(key[0], chain, turn, held, False)
        self._finish(chain, turn, held, before, self._now(timerValues))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "block_seq", "left", "right"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chain, turn = self._resume()
        held = {int(k[0]): v for k, v in self.waiting.iterator()}
        before = set(held)
        late = self.timer.exists() and self.timer.get()[1] == turn  # no block came in its turn since the timer was set
        turn, out = self._run(key[0], chain, turn, held, late)
        self._finish(chain, turn, held, before, self._now(timerValues))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "block_seq", "left", "right"])

    def close(self) -> None:
        pass


def stream(blocks: DataFrame, rate: float, settings: ChainSettings | None = None, patience_ms: int | None = None, most_waiting: int = 256) -> DataFrame:
    """The chain over a streaming DataFrame of blocks (needs the RocksDB state store).

    Mono or stereo in is mono or stereo out, in append mode; there is no tail and no delayed output.
    """
    check_schema(blocks)
    processor = ChainProcessor(settings or ChainSettings(), rate, patience_ms=patience_ms, most_waiting=most_waiting)
    return blocks.select("stream_id", "block_seq", "left", "right").groupBy("stream_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=STREAM_BLOCKS, outputMode="append", timeMode="none" if patience_ms is None else "processingTime")


def check_schema(blocks: DataFrame) -> None:
    """Blocks have a left channel and, for stereo, a right one."""
    missing = {"stream_id", "block_seq", "left", "right"} - set(blocks.columns)
    if missing:
        raise ValueError(f"blocks lack {sorted(missing)}")
