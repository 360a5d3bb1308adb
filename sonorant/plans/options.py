"""Options of the batch pipeline, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from sonorant.functions.dictionary import Dictionary
from sonorant.operators.speech import DenoiseSettings, GateSettings


@dataclass(frozen=True)
class PipelineOptions:
    denoise: bool = True
    denoise_settings: DenoiseSettings = field(default_factory=DenoiseSettings)
    silence: bool = False
    gate_settings: GateSettings = field(default_factory=GateSettings)
    censor: bool = False
    censor_mode: str = "mute"
    beep_hz: float = 1000.0
    beep_gain_db: float = 0.0
    censor_margin_ms: int = 40
    fade_ms: float = 5.0
    ranges: tuple[str, ...] = ()
    mastering: bool = True
    target_lufs: float = -16.0
    ceiling_db: float = -1.0
    ahead_ms: float = 5.0
    release_ms: float = 50.0
    gain_limit_db: float = 24.0
    dictionary: Dictionary = field(default_factory=Dictionary)

    def __post_init__(self) -> None:
        if self.censor_mode not in ("mute", "beep"):
            raise ValueError("censor_mode is 'mute' or 'beep'")
