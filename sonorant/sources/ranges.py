"""Manual ranges and the places where models are looked for."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorant.functions.levels import ms_to_samples
from sonorant.functions.text import parse_range

# File names of the speech-activity model beside a recogniser's model, first found first, and its kind;
# the default recogniser model, and how others begin.
VAD_NAMES = ("ggml-silero-v6.2.0.bin", "ggml-silero-v5.1.2.bin")
VAD_KIND = "silero"
MODEL_NAME, MODEL_PREFIX = "ggml-base.bin", "ggml-"


def manual_ranges(assets: DataFrame, specs: list[str]) -> DataFrame:
    """asset_id, start, end in samples, for every asset, of specs "a-b" in ms."""
    if not specs:
        return assets.select("asset_id", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")).where(F.lit(False))
    parsed = F.filter(F.transform(F.array(*[F.lit(s) for s in specs]), parse_range), lambda r: r.isNotNull())
    r = assets.select("asset_id", "sample_rate", F.explode(parsed).alias("r"))
    return r.select("asset_id", ms_to_samples(F.col("r.start_ms"), F.col("sample_rate")).alias("start"), ms_to_samples(F.col("r.end_ms"), F.col("sample_rate")).alias("end"))


def first_existing(candidates: Iterable[str], exists: Callable[[str], bool] = os.path.isfile) -> str | None:
    """The first candidate that exists, on the driver."""
    return next((c for c in candidates if c and exists(c)), None)


def folder_of(path: str) -> str:
    return path[: max(path.rfind("/"), path.rfind("\\")) + 1]


def listing(folder: str) -> list[str]:
    """The file names of a folder, sorted; none if it cannot be read."""
    try:
        return sorted(os.listdir(folder))
    except OSError:
        return []


def vad_model_beside(model: str, names: tuple[str, ...] = VAD_NAMES, exists: Callable[[str], bool] = os.path.isfile, files: Callable[[str], list[str]] = listing) -> str | None:
    """The speech-activity model in a model's folder: one of the fixed names, else any that is named after the kind."""
    folder = folder_of(model)
    other = (folder + f for f in files(folder or ".") if f.endswith(".bin") and VAD_KIND in f.lower())
    return first_existing((folder + n for n in names), exists) or next(other, None)


def model_folders(start: str, executable: str, user: str, bundle: str = "", levels: int = 12) -> list[str]:
    """Where models may be: the bundle, the user's folder, then `models` in the parents of two folders, and the parents."""
    found = [f for f in (bundle, user) if f]
    for at in (start, executable):
        for _ in range(levels):
            found += [os.path.join(at, "models"), at]
            if os.path.dirname(at) == at:
                break
            at = os.path.dirname(at)
    return list(dict.fromkeys(found))


def default_model(folders: Iterable[str], exists: Callable[[str], bool] = os.path.isfile, files: Callable[[str], list[str]] = listing) -> str | None:
    """The default model in the first folder that has it, else any other recogniser model in the first that has one."""
    folders = list(folders)
    other = (os.path.join(d, f) for d in folders for f in files(d) if f.startswith(MODEL_PREFIX) and f.endswith(".bin") and VAD_KIND not in f.lower())
    return first_existing((os.path.join(d, MODEL_NAME) for d in folders), exists) or next(other, None)
