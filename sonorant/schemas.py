"""Typed schemas of the engine's relations and the sentinels that stand for "no value"."""

from __future__ import annotations

ASSETS = "asset_id string, path string, sample_rate int, channels int, num_samples bigint, bits int, is_float boolean"
PCM_CHUNKS = "asset_id string, channel int, chunk_ix int, start_sample bigint, samples array<float>"
SAMPLES = "asset_id string, channel int, sample_ix bigint, value float"
FRAMES = "asset_id string, channel int, frame_ix int, real array<float>, imag array<float>"
MAGNITUDES = "asset_id string, channel int, frame_ix int, magnitude array<float>"
VAD_FRAMES = "asset_id string, channel int, frame_ix int, probability float, noise_magnitude array<float>"
ENVELOPE = "asset_id string, sample_ix bigint, gain float"
TOKENS = "asset_id string, segment_ix int, token_ix int, token_id int, text string, t0_cs bigint, t1_cs bigint, p float"
WORDS = "asset_id string, word_ix int, text string, start_ms bigint, end_ms bigint, probability float"
RANGES = "asset_id string, start bigint, end bigint"
DICTIONARY = "entry string, mode string"
STREAM_BLOCKS = "stream_id string, block_seq bigint, left array<float>, right array<float>"
REPORT = (
    "asset_id string, input_samples bigint, output_samples bigint, input_lufs float, final_lufs float, input_true_peak_db float, output_true_peak_db float, "
    "applied_gain_db float, limiter_reduction_db float, non_speech_ratio float, denoised_channels int, silenced_ratio float, "
    "transcript array<struct<text:string,start_ms:bigint,end_ms:bigint,probability:float>>, censored_ranges array<struct<start:bigint,end:bigint>>"
)

#: Loudness or peak of silence and of clips that are too short, in LUFS or dB.
NO_LEVEL = -100.0
#: Samples of a chunk row, so that no row grows with the recording.
CHUNK = 65_536
