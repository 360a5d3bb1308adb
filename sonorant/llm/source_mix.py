"""Mixing sources to target weights by pivotal dependent rounding (native).

Each document of a source gets the same fractional number of copies, target / source size. The whole part is taken;
the fraction is rounded by pivoting: two fractional documents trade probability, weighed by their sizes, until one of
them is 0 or 1, which keeps the source's expected words and, but for the last residual, its actual words. Blocks of
documents are folded in parallel; each leaves one residual, and residuals are folded again, level by level, until a
source has one, which a hash rounds. All randomness is a hash of doc_id, source, text and the seed, and so is the order
in which documents meet; so reruns agree, and so does the same table in other partitions (repeated rows are alike: which
of them is taken more often is open, how often they are together is not).

Defined cases: null source is a source of its own, last in order; null or empty text has size 0 and no copies beyond
the whole part; repeated rows are mixed as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import WORD, documents, fresh, materialise

#: Relative weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
_ITEM = "struct<h:bigint,rid:bigint,size:bigint,p:double>"
_DONE = "struct<rid:bigint,up:int>"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: words shared by weight; no source above most times its size.

    The excess is reshared until none is above: sources sorted by cap per weight fill up to a common level. One row
    per source, so the windows over all sources see a table of that size only.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(place, F.lit(len(weights))) + 1))
    by = by.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "ratio": F.col("source_size") * F.lit(float(most)) / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("before")) / F.col("rest")
    by = by.withColumn("level", F.max(F.when(level <= F.col("ratio"), level)).over(every))
    return by.select("source", "source_size", "n_docs", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _fold(items: Column, seed: int) -> Column:
    """Pivot the items of a block: struct<left: the residual or null, done: the decided ones>."""
    start = F.expr(f"named_struct('left', CAST(NULL AS {_ITEM}), 'done', CAST(array() AS array<{_DONE}>))")

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        wa, wb, pa, pb = (c.cast("double") for c in (a["size"], x["size"], a["p"], x["p"]))
        # a rises by up to gain (x falls by the same words), or x rises and a falls by loss: words are kept.
        gain = F.least((1 - pa) * wa, pb * wb)
        loss = F.least(pa * wa, (1 - pb) * wb)
        u = F.pmod(F.xxhash64(a["h"], x["h"], F.lit(seed)), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
        up = u * (gain + loss) < loss
        na = F.when(up, F.when((1 - pa) * wa <= pb * wb, F.lit(1.0)).otherwise(pa + gain / wa)).otherwise(F.when(pa * wa <= (1 - pb) * wb, F.lit(0.0)).otherwise(pa - loss / wa))
        nb = F.when(up, F.when((1 - pa) * wa <= pb * wb, pb - gain / wb).otherwise(F.lit(0.0))).otherwise(F.when(pa * wa <= (1 - pb) * wb, pb + loss / wb).otherwise(F.lit(1.0)))
        a_done = (na <= 0.0) | (na >= 1.0)

        def done(y: Column, p: Column) -> Column:
            return F.struct(y["rid"].alias("rid"), (p >= 1.0).cast("int").alias("up"))

        def left(y: Column, p: Column) -> Column:
            return F.struct(y["h"].alias("h"), y["rid"].alias("rid"), y["size"].alias("size"), p.alias("p"))

        both = a_done & ((nb <= 0.0) | (nb >= 1.0))
        pivot = F.struct(
            F.when(both, F.lit(None).cast(_ITEM)).when(a_done, left(x, nb)).otherwise(left(a, na)).alias("left"),
            F.when(both, F.concat(acc["done"], F.array(done(a, na), done(x, nb)))).when(a_done, F.concat(acc["done"], F.array(done(a, na)))).otherwise(F.concat(acc["done"], F.array(done(x, nb)))).alias("done"),
        )
        return F.when(a.isNull(), F.struct(x.cast(_ITEM).alias("left"), acc["done"].alias("done"))).otherwise(pivot)

    return F.aggregate(items, start, lambda acc, x: step(acc, x).cast(f"struct<left:{_ITEM},done:array<{_DONE}>>"))


def source_mix(docs: DataFrame, seed: int = 7, block: int = 48, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rid: str | None = None) -> DataFrame:
    """doc_id, rid, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source).

    block: documents folded in one step; a level leaves one residual for each block; rid: a column that numbers the rows,
    which are numbered here without it.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"), F.lit(seed)).alias("h"),
    )
    sized = materialise(sized, "mix-sizes")
    goal = materialise(targets(sized, weights, share, most), "mix-targets")
    sized = sized.join(goal.withColumnRenamed("source", "_goal"), F.col("source").eqNullSafe(F.col("_goal"))).drop("_goal")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    sized = sized.withColumns({"whole": F.floor(ratio).cast("long"), "p": ratio - F.floor(ratio)})
    settled = (F.col("p") <= 0.0) | (F.col("size") == 0)
    parts = [sized.where(settled).select("rid", F.lit(0).alias("up"))]
    items = sized.where(~settled).select("source", "h", "rid", "size", "p")
    largest = goal.agg(F.max("n_docs")).first()[0] or 0
    blocks, level = max(1, -(-largest // block)), 0
    while True:
        key = F.pmod(F.xxhash64("h", F.lit(seed + level)), F.lit(blocks))
        item = F.struct("h", "size", "p", "rid")  # in this order; rid tells only repeated rows apart
        folded = (
            items.groupBy("source", key.alias("block"))
            .agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["h"].alias("h"), x["rid"].alias("rid"), x["size"].alias("size"), x["p"].alias("p"))).alias("items"))
            .select("source", _fold(F.col("items"), seed).alias("f"))
        )
        folded = materialise(folded.select("source", "f.left", "f.done"), f"mix-level{level}")
        parts.append(folded.select(F.explode("done").alias("d")).select("d.rid", "d.up"))
        items = folded.where(F.col("left").isNotNull()).select("source", "left.h", "left.rid", "left.size", "left.p")
        if blocks == 1:
            break
        blocks, level = max(1, -(-blocks // block)), level + 1
    u = F.pmod(F.xxhash64("h", F.lit("last")), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    parts.append(items.select("rid", (u < F.col("p")).cast("int").alias("up")))
    ups = parts[0]
    for p in parts[1:]:
        ups = ups.unionByName(p)
    out = sized.join(ups, "rid").withColumn("copies", F.col("whole") + F.col("up"))
    return out.select("doc_id", "rid", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs itself as the mix has it: each document as often as it is taken, all columns kept.

    Rows are numbered and written first, and matched by number: doc_ids may be null or shared.
    """
    rid, copy = fresh(docs, "rid", "copy")
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-rows")
    copies = source_mix(rows, rid=rid, **options).where("copies > 0").select(F.col("rid").alias(rid), F.expr("sequence(1, copies)").alias(copy))
    return rows.join(copies, rid).withColumn(copy, F.explode(copy)).select(*docs.columns)
