"""The query catalogue's registry and its views of the test tables.

The tables hold no audio: an embedding of 64 floats serves as a piece of a signal, a user's events as a series, and the
words of conversations and documents as transcripts (a word lasts 400 ms).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RATE, WORD_MS = 44_100, 400


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, ix, text, start_ms, end_ms of the words of conversations."""
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("ix", "text"))
    return w.withColumns({"start_ms": F.col("ix").cast("bigint") * WORD_MS, "end_ms": (F.col("ix").cast("bigint") + 1) * WORD_MS})


def events(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, ms (since a fixed instant), value, event_id."""
    ms = F.timestamp_diff("MILLISECOND", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf, "events").select("user_id", "event_id", ms.alias("ms"), "value", "ts")


def chunks(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """PCM chunk rows: k embeddings in a row are a recording, one chunk each."""
    ix = F.col("vec_id") % k
    return table(spark, sf, "embeddings").select(
        F.call_function("div", F.col("vec_id"), F.lit(k).cast("bigint")).cast("string").alias("asset_id"), F.lit(0).alias("channel"), ix.cast("int").alias("chunk_ix"), (ix * 64).alias("start_sample"), F.col("embedding").alias("samples")
    )


def samples_sql(k: int) -> str:
    """a, i, x: the samples of chunks()."""
    return f"(SELECT vec_id // {k} AS a, (vec_id % {k}) * 64 + unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


W = "(SELECT conv_id, turn, unnest(range(0, len(string_split(text, ' ')))) AS ix, unnest(string_split(text, ' ')) AS text FROM conversations)"
EV = "(SELECT user_id, event_id, value, ts, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) // 1000 AS BIGINT) AS ms FROM events)"
