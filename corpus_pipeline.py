"""The corpus pipeline: classifier, exact dedup, near-duplicate join, source mix, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the
columns of `documents`. Rows that a stage drops are matched by a shuffle join, or by broadcast while they are few, and
always as rows, by digests of their texts or numbers given to them, as a doc_id may be null or shared.

Defined cases: null texts count as empty; repeated rows go in the exact dedup; an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, fresh, labels, lighten, materialise
from sonorant.llm.exact_dedup import exact_dedup, normalised
from sonorant.llm.kneser_ney import quality_classifier
from sonorant.llm.ngram_join import ngram_join
from sonorant.llm.packing import pack
from sonorant.llm.source_mix import mixed

#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of docs whose keys are not in gone (nulls equal)."""
    names = fresh(docs, *[f"gone_{k}" for k in keys])
    gone = gone.select([F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return docs.join(side, on, "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the quality classifier rejects, each by its own text and language.

    Labels are learned by doc_id; a null or empty text is kept; rows that share an id are judged apart.
    """
    lighten(spark)
    (digest,) = fresh(docs, "digest")
    row = ["doc_id", "lang", digest]  # what the verdict depends on
    marked = docs.withColumn(digest, F.sha2(F.col("text").cast("binary"), 256))
    judged = quality_classifier(marked, labels(spark, sf_dir), carry=(digest,))
    return without(marked, materialise(judged.where("NOT kept").select(row).distinct(), "rejected"), row).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows with equal texts the one with the least doc_id, nulls last; of repeated rows one, whichever."""
    (digest,) = fresh(docs, "digest")
    found = materialise(exact_dedup(docs), "exact")
    by = found.groupBy("doc_id", F.col("text_sha256").alias(digest)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    by = materialise(by.where("NOT kept OR n > 1"), "exact-gone")
    marked = docs.withColumn(digest, F.sha2(normalised(F.col("text")).cast("binary"), 256))
    left = without(marked, by.where("NOT kept"), ["doc_id", digest])
    if not by.where("kept").isEmpty():  # repeated rows: one of each stays
        left = left.dropDuplicates(["doc_id", digest])
    return left.select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows the one with the least doc_id, nulls last; rows that link with nothing stay."""
    lighten(spark)
    (rid,) = fresh(docs, "rid")
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "near-rows")
    found = ngram_join(rows.select(F.col(rid).alias("doc_id"), "text")).where("doc_id <> component_id")
    found = materialise(found.select(F.col("doc_id").alias(rid), "component_id"), "near-found")
    linked = found.unionByName(found.select(F.col("component_id").alias(rid), "component_id").distinct())
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(rid))
    stay = linked.join(rows.select(rid, "doc_id"), rid).groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{rid}")
    gone = without(linked.select(rid), materialise(stay, "near-stay"), [rid])
    return without(rows, materialise(gone, "near-gone"), [rid]).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is a source, rows without words come as often as the whole
    part of their source's copies."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; a null or empty text is one piece of one token."""
    lighten(spark)
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality classifier", classify), ("exact dedup", dedup), ("n-gram Jaccard join", near), ("mixing sources", mix), ("best-fit packing", packed)]

#: No SQL: the language model, the rounding and the packing have no form in it; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
