"""Matching words against a dictionary."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorant.functions.dictionary import Dictionary
from sonorant.functions.text import flag_line, normalise


def is_listed(norm: Column, dictionary: Dictionary) -> Column:
    """Whether a normal form contains a root or is a whole-word entry; an empty one never is.

    The dictionary is of fixed size, so the roots fold to one alternation and the words to one IN list: no join at all.
    """
    roots = dictionary.minimal_roots()
    hit = norm.rlike("|".join(map(re.escape, roots))) if roots else F.lit(False)
    if dictionary.words:
        hit = hit | norm.isin(*dict.fromkeys(dictionary.words))
    return (norm != "") & hit


def flag(words: DataFrame, dictionary: Dictionary, text: str = "text") -> DataFrame:
    """words with `flagged`."""
    return words.withColumn("flagged", is_listed(normalise(F.col(text)), dictionary))


def listed(words: DataFrame, dictionary: Dictionary, text: str = "text") -> DataFrame:
    """The words that are to be concealed."""
    return words.where(is_listed(normalise(F.col(text)), dictionary))


def semi_join_roots(words: DataFrame, roots: DataFrame, norm: str = "norm", entry: str = "entry", gram: int = 3, most: int = 100_000) -> DataFrame:
    """Rows whose normal form contains an entry of the table `roots`, of any size.

    An equi-join on each entry's first `gram` letters finds candidates among a word's grams and `contains` checks them,
    instead of a nested loop over the dictionary. Grams are as long as entries need: shorter entries are asked for by
    their own length. Up to `most` entries are broadcast, and their hits with them while those are as few.
    """
    entries = roots.select(F.col(entry).alias("_entry")).where(F.length("_entry") > 0).distinct()
    entries = entries.withColumn("_gram", F.substring("_entry", 1, gram))
    sizes = [r["n"] for r in entries.groupBy(F.length("_gram").alias("n")).count().collect()]  # at most `gram` rows
    if not sizes:
        return words.where(F.lit(False))
    word, n = words.select(norm).distinct(), F.length(norm)
    grams = F.concat(*[F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(F.col(norm), i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in sorted(sizes)])
    side = F.broadcast(entries) if entries.limit(most + 1).count() <= most else entries
    hits = word.withColumn("_gram", F.explode(F.array_distinct(grams))).join(side, "_gram").where(F.contains(norm, "_entry")).select(norm).distinct()
    return words.join(hits, norm, "left_semi")


def semi_join_words(words: DataFrame, whole: DataFrame, norm: str = "norm", entry: str = "entry") -> DataFrame:
    """Rows whose normal form is an entry of the table `whole`."""
    entries = whole.select(F.col(entry).alias(norm)).where(F.length(norm) > 0).distinct()
    return words.join(entries, norm, "left_semi")


def transcript_lines(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """asset_id, word_ix, line: the report's transcript rows, listed words marked."""
    shown = flag(words, dictionary)
    return shown.select("asset_id", "word_ix", flag_line(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("flagged")).alias("line"))
