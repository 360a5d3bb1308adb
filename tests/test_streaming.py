"""The streaming chain: any cut into blocks, batch and stream, gives the same samples."""

from __future__ import annotations

import json

import numpy as np
import pytest

from sonorant.schemas import STREAM_BLOCKS
from sonorant.streaming import chain

RNG = np.random.default_rng(7)
LEFT = (0.5 * np.sin(2 * np.pi * 300 * np.arange(3000) / 48_000) + RNG.normal(0, 0.01, 3000)).astype(np.float32)
RIGHT = (0.3 * np.sin(2 * np.pi * 500 * np.arange(3000) / 48_000)).astype(np.float32)


def whole(stereo=True, **settings):
    return chain.Chain(chain.ChainSettings(**settings), 48_000.0).process(LEFT, RIGHT if stereo else None)


@pytest.mark.parametrize("size", [1, 64, 1000])
def test_blocks_do_not_matter(size):
    c, out = chain.Chain(chain.ChainSettings(), 48_000.0), []
    for at in range(0, 3000, size):
        state = c.save()  # as a restart would
        c = chain.Chain(chain.ChainSettings(), 48_000.0)
        c.load(state)
        out.append(c.process(LEFT[at : at + size], RIGHT[at : at + size])[0])
    assert np.allclose(np.concatenate(out), whole()[0], atol=1e-6)


def test_switches_and_ceiling():
    loud = whole(output_gain_db=12.0)[0]
    assert np.abs(loud).max() <= 10 ** (-1 / 20) + 1e-6
    off = dict(hpf=False, gate=False, compressor=False, eq=False, limiter=False)
    assert np.allclose(whole(**off)[0], LEFT, atol=1e-6)
    assert whole(stereo=False)[1] is None


def test_settings_state():
    s = chain.ChainSettings(ratio=100.0, gate=False)
    assert s.ratio == 8.0 and chain.ChainSettings.from_json(s.to_json()) == s
    assert chain.ChainSettings.from_json(json.dumps({"kind": "other"})) == chain.ChainSettings() == chain.ChainSettings.from_json("<")


def test_batch(spark):
    rows = [("s", i, [float(v) for v in LEFT[at : at + 500]], [float(v) for v in RIGHT[at : at + 500]]) for i, at in enumerate(range(0, 3000, 500))]
    got = chain.batch(spark.createDataFrame(rows, STREAM_BLOCKS), 48_000.0).orderBy("block_seq").collect()
    assert np.allclose(np.concatenate([r["left"] for r in got]), whole()[0], atol=1e-6)


def test_stream_with_late_blocks(spark, tmp_path):
    order = [0, 2, 1, 1, 3, 5, 4]  # out of order, one twice
    for n, i in enumerate(order):
        at = 500 * i
        rows = [("s", i, [float(v) for v in LEFT[at : at + 500]], [float(v) for v in RIGHT[at : at + 500]])]
        spark.createDataFrame(rows, STREAM_BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    src = spark.readStream.schema(STREAM_BLOCKS).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = chain.stream(src, 48_000.0).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("block_seq").collect()
    assert [r["block_seq"] for r in got] == [0, 1, 2, 3, 4, 5]
    assert np.allclose(np.concatenate([r["right"] for r in got]), whole()[1], atol=1e-6)


def test_stream_goes_on_after_a_lost_block(spark, tmp_path):
    for i in (0, 2, 3, 4, 1):  # 1 comes after the others were done without it
        at = 500 * i
        spark.createDataFrame([("s", i, [float(v) for v in LEFT[at : at + 500]], None)], STREAM_BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(STREAM_BLOCKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chain.stream(src, 48_000.0, most_waiting=1).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert [r["block_seq"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("block_seq").collect()] == [0, 2, 3, 4]


def test_stream_loses_patience(spark, tmp_path):
    import time

    for i in (0, 2):  # 1 never comes
        at = 500 * i
        spark.createDataFrame([("s", i, [float(v) for v in LEFT[at : at + 500]], None)], STREAM_BLOCKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(STREAM_BLOCKS).parquet(str(tmp_path / "in"))
    q = chain.stream(src, 48_000.0, patience_ms=1500).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start(str(tmp_path / "out"))
    try:
        for _ in range(60):
            time.sleep(1)
            seen = [r["block_seq"] for r in spark.read.schema(STREAM_BLOCKS).parquet(str(tmp_path / "out")).collect()] if (tmp_path / "out").is_dir() else []
            if len(seen) == 2:
                break
        assert sorted(seen) == [0, 2]
    finally:
        q.stop()


def test_patience_passes_over_lost_blocks():
    p, c = chain.ChainProcessor(chain.ChainSettings(), 48_000.0), chain.Chain(chain.ChainSettings(), 48_000.0)
    held = {i: (LEFT[:10], None) for i in (3, 4, 6)}
    assert p._run("s", c, 1, held, False) == (1, []) and len(held) == 3
    turn, out = p._run("s", c, 1, held, True)
    assert turn == 5 and [x[1] for x in out] == [3, 4] and set(held) == {6}


def test_schema_check(spark):
    with pytest.raises(ValueError):
        chain.check_schema(spark.createDataFrame([("s", 1)], "stream_id string, block_seq bigint"))
