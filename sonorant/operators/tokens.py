"""Recogniser tokens to transcript words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorant.functions.text import begins_word, strip_lead


def usable(tokens: DataFrame, end_id: int) -> DataFrame:
    """Tokens that carry text: no special ids, no null or empty text."""
    return tokens.where((F.col("token_id") < end_id) & F.col("text").isNotNull() & (F.col("text") != ""))


def to_words(tokens: DataFrame, end_id: int, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """keys, word_ix, text, start_ms, end_ms, probability.

    A word begins at a token with leading space or newline, or at the first one; it has its first token's start, its
    last one's end and the mean probability. Words without text are dropped; a token run that is empty so far does not
    keep the next token from beginning a word.
    """
    t = usable(tokens, end_id)
    order = Window.partitionBy(*keys).orderBy("segment_ix", "token_ix")
    first = F.row_number().over(order) == 1
    t = t.withColumn("_word", F.sum(F.when(begins_word(F.col("text")) | first, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("segment_ix", "token_ix").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("segment_ix", "token_ix")
    parts = F.sort_array(F.collect_list(F.struct("segment_ix", "token_ix", strip_lead(F.col("text")).alias("s"))))
    words = t.groupBy(*keys, "_word").agg(
        F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("text"), (F.min_by("t0_cs", at) * 10).alias("start_ms"), (F.max_by("t1_cs", at) * 10).alias("end_ms"), F.avg("p").alias("probability")
    )
    words = words.where("text <> ''")
    return words.withColumn("word_ix", (F.row_number().over(Window.partitionBy(*keys).orderBy("_word")) - 1).cast("int")).select(*keys, "word_ix", "text", "start_ms", "end_ms", "probability")
