"""Exact dedup with a heavy-hitter split (native).

A Misra-Gries style frequent-items sketch (Spark's approx_top_k, a mergeable sketch of fixed size) nominates digests
that may be frequent. An exact, map-side combined count verifies the nominees; the verified winners (at most
`max_heavy` rows) are broadcast and their rows never shuffle. All other digests use ordinary shuffling: counts combined
map-side, and a join of the rows with the groups of two or more.

Defined cases: a null text counts as empty; ties (equal doc_id and equal text) leave exactly one row; a null doc_id is
larger than every other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, materialise

#: A run of white space that isn't already one plain space.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def nominees(digests: DataFrame, max_heavy: int, tracked: int) -> DataFrame:
    """At most max_heavy digests that may be frequent, from the mergeable sketch."""
    top = digests.agg(F.expr(f"approx_top_k(digest, {max_heavy}, {tracked})").alias("top"))
    return top.select(F.explode("top.item").alias("digest"))


def exact_dedup(docs: DataFrame, max_heavy: int = 512, tracked: int = 4096, heavy_rows: int = 500) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    max_heavy bounds the broadcast winners, tracked the sketch; a nominee with under heavy_rows rows is not a winner.
    """
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))  # 32 bytes
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), sha.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    group = [F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")]
    hex_ = rows.select(F.hex("digest").alias("digest"))  # the sketch takes strings
    found = nominees(hex_, max_heavy, tracked).select(F.unhex("digest").alias("digest"))
    winners = rows.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(*group).where(F.col("group_size") >= heavy_rows)
    winners = materialise(winners, "heavy")  # max_heavy rows at most
    heavy = rows.join(F.broadcast(winners), "digest")
    # Groups are combined map-side; the join back is one that Spark can split where a digest is frequent after all.
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    several = materialise(light.groupBy("digest").agg(*group).where("group_size > 1"), "groups")
    light = light.join(several, "digest", "left").select("doc_id", "digest", "row", F.coalesce("first", order).alias("first"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    every = heavy.select("doc_id", "digest", "row", "first", "group_size").unionByName(light)
    return every.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("first.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
