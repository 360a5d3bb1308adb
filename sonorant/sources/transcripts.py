"""Transcript providers: where the words of a recording come from."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sonorant.operators.spectral import resampled_chunks
from sonorant.operators.tokens import to_words
from sonorant.schemas import TOKENS, WORDS


class TranscriptProvider(ABC):
    """Gives words (WORDS) for mono chunk rows."""

    @property
    @abstractmethod
    def name(self) -> str: ...

    @abstractmethod
    def transcribe(self, mono: DataFrame, rate: float) -> DataFrame: ...


class TableTranscripts(TranscriptProvider):
    """Words computed elsewhere, as JSON or Parquet or any DataFrame."""

    def __init__(self, words: DataFrame, name: str = "table") -> None:
        self.words, self._name = words, name

    @classmethod
    def read(cls, spark: SparkSession, path: str, kind: str = "parquet") -> TableTranscripts:
        return cls(spark.read.schema(WORDS).format(kind).load(path), path)

    @property
    def name(self) -> str:
        return self._name

    def transcribe(self, mono: DataFrame, rate: float) -> DataFrame:
        return self.words.join(mono.select("asset_id").distinct(), "asset_id", "left_semi")


@dataclass(frozen=True)
class RecogniserOptions:
    """Decoding options of a speech recogniser."""

    model_path: str = ""
    vad_model_path: str = ""
    language: str = "auto"
    beam_size: int = 5
    use_vad: bool = True
    suppress_non_speech: bool = True
    translate: bool = False
    threads: int = 0
    best_of: int = 5
    temperature: float = 0.0
    temperature_step: float = 0.4
    speech_pad_ms: int = 60

    @property
    def auto_language(self) -> bool:
        return self.language in ("", "auto")

    def vad_enabled(self) -> bool:
        return self.use_vad and bool(self.vad_model_path)

    def decoding(self) -> dict[str, object]:
        """What a model backend gets."""
        search = {"strategy": "beam", "beam_size": self.beam_size} if self.beam_size > 1 else {"strategy": "greedy", "best_of": self.best_of}
        vad = {"vad": True, "vad_model_path": self.vad_model_path, "speech_pad_ms": self.speech_pad_ms} if self.vad_enabled() else {"vad": False}
        rest = {"temperature": self.temperature, "temperature_step": self.temperature_step, "no_context": True, "suppress_blank": True, "suppress_non_speech": self.suppress_non_speech}
        return search | vad | rest | {"translate": self.translate, "threads": self.threads or os.cpu_count() or 1, "language": None if self.auto_language else self.language, "detect_language": self.auto_language}

    def description(self) -> str:
        parts = [os.path.basename(self.model_path) or "no model", f"beam {self.beam_size}" if self.beam_size > 1 else "greedy", f"language {self.language or 'auto'}"]
        return ", ".join(parts + (["vad"] if self.vad_enabled() else []))


class RecogniserTranscripts(TranscriptProvider):
    """A speech recogniser: `load(options)` runs once a Python worker and returns a function of one mono signal.

    That function gets the samples at 16 kHz and gives rows of TOKENS without asset_id. A recording is handed over whole, as
    recognisers need it; words follow from tokens in SQL.
    """

    RATE = 16_000.0

    def __init__(self, options: RecogniserOptions, load: Callable[[dict[str, object]], Callable] | None = None, end_id: int = 50_257) -> None:
        self.options, self.load, self.end_id = options, load, end_id

    @property
    def name(self) -> str:
        return self.options.description()

    def is_ready(self) -> bool:
        return self.load is not None and bool(self.options.model_path)

    def tokens(self, mono: DataFrame, rate: float) -> DataFrame:
        load, decoding = self.load, self.options.decoding()
        at_rate = resampled_chunks(mono, rate, self.RATE)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            recognise, names = load(decoding), [c.split()[0] for c in TOKENS.split(", ")]
            key, held = None, []

            def flush() -> pd.DataFrame:
                import numpy as np

                rows = recognise(np.concatenate(held) if held else np.zeros(0, dtype=np.float32))
                return pd.DataFrame([{"asset_id": key} | r for r in rows], columns=names)

            for b in batches:
                for asset, samples in zip(b["asset_id"], b["samples"], strict=True):
                    if asset != key:
                        if key is not None:
                            yield flush()
                        key, held = asset, []
                    held.append(samples)
            if key is not None:
                yield flush()

        return at_rate.repartition("asset_id").sortWithinPartitions("asset_id", "chunk_ix").mapInPandas(run, TOKENS)

    def transcribe(self, mono: DataFrame, rate: float) -> DataFrame:
        if not self.is_ready():
            return mono.sparkSession.createDataFrame([], WORDS)
        return to_words(self.tokens(mono, rate), self.end_id)
