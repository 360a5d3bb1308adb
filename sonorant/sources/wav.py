"""WAV files as chunk rows, and back.

Reading goes through Spark's binaryFile source, so any store Spark reads will do. The RIFF chunks are walked in a view
of the bytes and samples are decoded chunk row by chunk row; what is not needed is never copied.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.functions.text import clean_name
from sonorant.schemas import ASSETS, CHUNK, PCM_CHUNKS

NOT_RIFF = "not a RIFF/WAVE file"
BAD_FORMAT = "invalid fmt chunk"
INCOMPLETE = "incomplete WAV (missing fmt/data)"
EXTENSIBLE, FLOAT = 0xFFFE, 3


class WavError(ValueError):
    pass


@dataclass(frozen=True)
class WavInfo:
    rate: int
    channels: int
    bits: int
    is_float: bool
    align: int
    data: memoryview
    size: int  # bytes that the data chunk announces; what is missing reads as zeros

    @property
    def samples(self) -> int:
        return self.size // self.align


def parse(raw: bytes) -> WavInfo:
    """The format and the sample bytes of a file. The last data chunk counts; unknown chunks are skipped with padding."""
    view = memoryview(raw)
    if len(raw) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise WavError(NOT_RIFF)
    at, fmt, data, size = 12, None, memoryview(b""), 0
    while at + 8 <= len(raw):
        name, length = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        body = view[at + 8 : at + 8 + length]
        at += 8 + length
        if name == b"fmt ":
            if length < 16 or len(body) < 16:
                raise WavError(BAD_FORMAT)
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", body)
            if tag == EXTENSIBLE and length >= 26:
                tag = struct.unpack_from("<H", body, 24)[0]
            fmt = (tag, channels, rate, align, bits)
        elif name == b"data":
            data, size = body, length
        else:
            at += length & 1
    if fmt is None or min(fmt[1], fmt[2], fmt[4]) <= 0 or size == 0:
        raise WavError(INCOMPLETE)
    tag, channels, rate, align, bits = fmt
    return WavInfo(rate, channels, bits, tag == FLOAT, align or channels * (bits // 8), data, size)


def decode(info: WavInfo, first: int, count: int) -> np.ndarray:
    """Samples [first, first + count) as floats, a row for each channel; unsupported encodings read as zeros."""
    width, raw = info.bits // 8, bytes(info.data[first * info.align : (first + count) * info.align])
    raw += bytes(count * info.align - len(raw))
    if width == 0 or width * info.channels > info.align:
        return np.zeros((info.channels, count), dtype=np.float32)
    grid = np.frombuffer(raw, dtype=np.uint8).reshape(count, info.align)[:, : width * info.channels].reshape(count, info.channels, width)
    if info.is_float and width in (4, 8):
        x = np.ascontiguousarray(grid).view("<f4" if width == 4 else "<f8")[..., 0]
    elif not info.is_float and width in (2, 4):
        x = np.ascontiguousarray(grid).view("<i2" if width == 2 else "<i4")[..., 0] / float(1 << (info.bits - 1))
    elif not info.is_float and width == 3:
        wide = np.concatenate([np.zeros_like(grid[..., :1]), grid], axis=2)
        x = (np.ascontiguousarray(wide).view("<i4")[..., 0] >> 8) / float(1 << 23)
    else:
        x = np.zeros((count, info.channels))
    return x.T.astype(np.float32)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, with `error` for those that are no readable WAV."""
    return described(_files(spark, path).select("path", "content"))


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all readable files; `read_assets` has the errors of the others."""
    return decoded(_files(spark, path).select("path", "content"), chunk)


def _one_by_one(df: DataFrame) -> DataFrame:
    """A file is a row; a worker gets a few megabytes of them at a time, or one."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 64), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        if not 0 < int(df.sparkSession.conf.get(key).rstrip("b")) <= most:
            df.sparkSession.conf.set(key, most)
    return df


def described(files: DataFrame) -> DataFrame:
    """ASSETS and `error` of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, raw in zip(b["path"], b["content"], strict=True):
                try:
                    w = parse(raw)
                    rows.append((name, name, w.rate, w.channels, w.samples, w.bits, w.is_float, None))
                except WavError as e:
                    rows.append((name, name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*[c.split()[0] for c in ASSETS.split(", ")], "error"]).astype({"sample_rate": "Int32", "channels": "Int32", "num_samples": "Int64", "bits": "Int32", "is_float": "boolean"})

    return _one_by_one(files).mapInPandas(run, ASSETS + ", error string")


def decoded(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """PCM_CHUNKS of files (path, content); what is no readable WAV has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                try:
                    w = parse(raw)
                except WavError:
                    continue
                for i, first in enumerate(range(0, w.samples, chunk)):
                    x = decode(w, first, min(chunk, w.samples - first))
                    yield pd.DataFrame({"asset_id": name, "channel": range(w.channels), "chunk_ix": i, "start_sample": first, "samples": list(x)})

    return _one_by_one(files).mapInPandas(run, PCM_CHUNKS)


def header(rate: int, channels: int, bits: int, samples: int) -> bytes:
    """The 44 bytes before the samples; 32 bits are float, 16 are integers."""
    align = channels * (bits // 8)
    size = samples * align
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if bits == 32 else 1, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", size)


def encode(x: np.ndarray, bits: int) -> bytes:
    """Interleaved samples (a row for each channel), clamped to [-1, 1]; integers round half away from zero."""
    if bits not in (16, 32):
        raise WavError("bit depth must be 16 or 32")
    held = np.clip(np.asarray(x, dtype=np.float32), -1.0, 1.0)
    if bits == 32:
        return held.T.astype("<f4").tobytes()
    scaled = held.T * np.float32(32767.0)
    return (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype("<i2").tobytes()


def encoded(chunks: DataFrame, assets: DataFrame, bits: int = 16) -> DataFrame:
    """asset_id, part_ix, content: the pieces of each output file in order; piece 0 is the header.

    Each chunk is encoded on its own, so no task holds a whole recording.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"asset_id": b["asset_id"], "part_ix": b["chunk_ix"] + 1, "content": [encode(np.stack([np.asarray(s) for s in x]), bits) for x in b["all"]]})

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"asset_id": b["asset_id"], "part_ix": 0, "content": [header(int(r), int(c), bits, int(n)) for r, c, n in zip(b["sample_rate"], b["channels"], b["num_samples"], strict=True)]})

    ordered = F.transform(F.sort_array(F.collect_list(F.struct("channel", "samples"))), lambda s: s["samples"])
    body = chunks.groupBy("asset_id", "chunk_ix").agg(ordered.alias("all")).mapInPandas(run, "asset_id string, part_ix int, content binary")
    return body.unionByName(assets.select("asset_id", "sample_rate", "channels", "num_samples").mapInPandas(heads, "asset_id string, part_ix int, content binary"))


def output_name(asset_id: Column, common: str) -> Column:
    """The output's path below the output folder: the input's below the folder that all inputs have in common."""
    return clean_name(F.substring(asset_id, F.lit(len(common) + 1), F.length(asset_id)))


def common_folder(assets: DataFrame) -> str:
    """The folder that all assets are in, with its last slash: what the first and the last path share."""
    ends = assets.agg(F.min("asset_id"), F.max("asset_id")).first()
    shared = os.path.commonprefix([x or "" for x in ends])
    return shared[: shared.rfind("/") + 1]


def check_names(assets: DataFrame, common: str) -> None:
    """An error if two inputs would have one output."""
    clash = assets.groupBy(output_name(F.col("asset_id"), common).alias("name")).agg(F.countDistinct("asset_id").alias("n")).where("n > 1").first()
    if clash is not None:
        raise WavError(f"{clash['n']} inputs have one output, {clash['name']}")


def write(chunks: DataFrame, assets: DataFrame, folder: str, bits: int = 16, common: str | None = None) -> DataFrame:
    """Write each asset as <folder>/<path below the common input folder>_clean.wav, through the executors' mount.

    folder must be one that all executors share. Pieces of an asset arrive in order and are appended as they come; the
    file is renamed when complete, so that a lost executor leaves no half file. Inputs that would have one output are an
    error. common: the input folder, where assets are a part of the inputs. Returns asset_id, path, bytes.
    """
    common = common_folder(assets) if common is None else common
    check_names(assets, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, out, final, done = None, None, "", []

        def finish() -> None:
            if out is not None:
                size = out.tell()
                out.close()
                os.replace(out.name, final)
                done.append((current, final, size))

        for b in batches:
            for asset, name, content in zip(b["asset_id"], b["name"], b["content"], strict=True):
                if asset != current:
                    finish()
                    current, final = asset, f"{folder}/{name}"
                    os.makedirs(os.path.dirname(final), exist_ok=True)
                    out = open(f"{final}.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                out.write(content)
        finish()
        yield pd.DataFrame(done, columns=["asset_id", "path", "bytes"])

    named = encoded(chunks, assets, bits).withColumn("name", output_name(F.col("asset_id"), common))
    return named.repartition("asset_id").sortWithinPartitions("asset_id", "part_ix").mapInPandas(run, "asset_id string, path string, bytes bigint")
