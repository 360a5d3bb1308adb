"""Quality rules: an isolation forest on rule statistics.

Every text is reduced to rule statistics in one pass (word length, shares of symbols, capitals, repeats, ...), which are
written once. Labelled ids fall into two halves by a hash. All rows of the first are the training set: the good ones set
the statistics' units (quantiles, by Spark's mergeable summary), and each tree has `subsample` of the set's rows, drawn
anew for each tree, as an isolation forest has it. A document whose mean path is short is anomalous. A split's
statistic is drawn in proportion to the ranges that the node's rows have, as in random cut forests, in units of the
spread that the good labelled rows have; so a statistic that is nearly constant among good documents and not in the
training set is split first, and nobody sets a range by hand. The threshold comes from all rows of the other half: it
rejects as many bad rows as it can, and good ones at a price that `false_rejects` sets. Up to 20,000 labelled rows go to
the driver; beyond, it sees the trees' rows alone, drawn by hashes (trees x 192 expected, whatever the corpus), and the
counts of all scores in at most 1,000,000 cells.
The forest (trees x 2 * subsample nodes) is of fixed size and travels with the scoring function.

Defined cases: a null text has no words; texts under 50 words fail the base rule; without labelled rows of both classes
in each half, those that fail the base rule aside, the method rejects nothing; of rows that share a
labelled id one is learned from, and a label given twice counts as the lower; repeated rows are scored one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, id_in, id_out, labels, materialise, small_batches

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>"
_STOP = b".,;:!?"
_BLANK = b" \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule statistics, the forest's inputs.
RULES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "bangs", "one_char")


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The contract's counts (BASE) and the forest's inputs (RULES) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, size = len(words), len(raw)
    chars = len(text or "") - (size - len(raw.translate(None, _BLANK)))
    count = lambda which: size - len(raw.translate(None, which))
    symbols = count(_SYMBOL)
    worded = [x for x in lines if x.strip()]
    dups = len(worded) - len(set(worded))
    repeated = 0
    if n > 3 and len(set(zip(words, words[1:], words[2:], strict=False))) < n - 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    per = max(n, 1)
    rules = [
        chars / per, symbols / per, dups / max(len(worded), 1), repeated / per, count(_UPPER) / max(chars, 1), count(_DIGIT) / max(chars, 1),
        count(_STOP) / per, raw.count(b"!") / per, sum(1 for w in words if len(w) == 1) / per,
    ]
    return [n, chars, symbols, dups, repeated], rules


def fails(counts: list[int]) -> bool:
    """The contract's base rule."""
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as flat arrays (tree, node): rule, split, path length at leaves; children of node k are 2k+1 and 2k+2."""

    rule: np.ndarray
    split: np.ndarray
    path: np.ndarray
    depth: int
    norm: float
    centre: np.ndarray
    unit: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / norm) for each row: near 1 is anomalous."""
        if not len(x):
            return np.zeros(0)
        x = (x - self.centre) / self.unit
        trees = np.arange(self.rule.shape[0])[None, :]
        node = np.zeros((len(x), self.rule.shape[0]), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            rule = self.rule[trees, node]
            right = x[rows, np.maximum(rule, 0)] >= self.split[trees, node]
            node = np.where(rule < 0, node, 2 * node + 1 + right)
        return 2.0 ** (-self.path[trees, node].mean(axis=1) / self.norm)


def grow(x: np.ndarray | list[np.ndarray], spread: np.ndarray, trees: int = 128, subsample: int = 64, least_unit: float = 0.01, seed: int = 11) -> Forest:
    """A forest on the rows of x, or with a tree on each part of a list; spread: the low, middle and high of each
    statistic among good rows, which set the units (least_unit where they hardly differ)."""
    rng = np.random.default_rng(seed)
    low, centre, high = spread
    unit = np.maximum(high - low, least_unit)
    m = min(subsample, max(map(len, x)) if isinstance(x, list) else len(x))
    depth = max(1, math.ceil(math.log2(max(m, 2))))
    nodes = 2 ** (depth + 1) - 1
    rule, split, path = np.full((trees, nodes), -1, dtype=np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        part = x[t] if isinstance(x, list) else x[rng.choice(len(x), m, replace=False)]
        todo = [(0, (part - centre) / unit, 0)]
        while todo:
            k, part, d = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            ends = np.cumsum(high - low)
            at, j = 0.0, -1
            if d < depth and ends[-1] > 0:
                j = int(np.searchsorted(ends, rng.uniform(0, ends[-1]), side="right"))
                at = rng.uniform(low[j], high[j])
            right = part[:, max(j, 0)] >= at
            if j < 0 or right.all() or not right.any():
                path[t, k] = d + float(_mean_path(len(part)))
                continue
            rule[t, k], split[t, k] = j, at
            todo += [(2 * k + 1, part[~right], d + 1), (2 * k + 2, part[right], d + 1)]
    return Forest(rule, split, path, depth, max(float(_mean_path(m)), 1e-9), centre, unit)


def threshold(cells: pd.DataFrame, false_rejects: float) -> float:
    """The score above which a document is rejected: the one with the best share of bad rows above it, less that of good
    rows, where ten times `false_rejects` of the good weigh as much as all bad; halfway to the next higher score.

    cells: low, high (the least and largest score), good, bad (rows) of each cell of scores."""
    cells = cells.sort_values("low")
    good, bad = cells["good"].to_numpy(dtype=float), cells["bad"].to_numpy(dtype=float)
    above = [1.0 - np.cumsum(x) / x.sum() for x in (good, bad)]
    best = int(np.argmax(above[1] - above[0] / (10 * false_rejects)))
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    return float((high[best] + low[min(best + 1, len(low) - 1)]) / 2 if best + 1 < len(low) else high[best])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the BASE counts, failed, rules for each row of docs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [rule_statistics(t) for t in b["text"]]
            base = np.array([r for r, _ in found], dtype=np.int64).reshape(-1, len(BASE))
            yield pd.DataFrame({"doc_id": b["doc_id"], **{n: base[:, i] for i, n in enumerate(BASE)}, "failed": [fails(c) for c, _ in found], "rules": [r for _, r in found]})

    shape = "doc_id string, " + ", ".join(f"{n} long" for n in BASE) + ", failed boolean, rules array<double>"
    return id_out(docs.select(id_in("doc_id"), "text").mapInPandas(rows, shape))


def learned_rows(stats: DataFrame, marks: DataFrame, most: int = 1_000_000) -> DataFrame:
    """doc_id, quality, rules, half (0: training) of every labelled id that passes the base rule, one row of each; ids are
    broadcast while they are at most `most`."""
    ids = marks.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("long").alias("quality"))
    rows = stats.select("doc_id", "failed", "rules").join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "failed", "rules")).alias("r")).select("doc_id", "r.*").where("NOT failed").drop("failed")
    return rows.withColumn("half", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2)))


def tree_rows(rows: DataFrame, n: int, trees: int, subsample: int, seed: int) -> list[np.ndarray]:
    """For each tree its subsample of rows (n in all): those with the least hashes of doc_id and tree, so that reruns agree.

    Rows above a hash that 3 * subsample rows are expected to stay below are not sent."""
    top = 1 << 40
    bound = min(top, 3 * subsample * top // n + 1)
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col("doc_id")), F.lit(top))
    drawn = rows.select("doc_id", "rules", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("h", hashed).where(F.col("h") < bound)
    got = drawn.toPandas().sort_values(["tree", "h", "doc_id"]).groupby("tree").head(subsample)
    return [np.array(x.tolist(), dtype=float).reshape(-1, len(RULES)) for _, x in got.groupby("tree")["rules"]]


def _spread(good: DataFrame) -> np.ndarray:
    """The low, middle and high of each statistic, by mergeable summaries of all rows."""
    top = good.agg(*[F.expr(f"percentile_approx(rules[{i}], array(0.005D, 0.5D, 0.995D), 100000)").alias(n) for i, n in enumerate(RULES)]).first()
    return np.array([top[n] for n in RULES]).T


def fit(stats: DataFrame, marks: DataFrame, false_rejects: float = 0.002, trees: int = 128, subsample: int = 64, seed: int = 11, most_local: int = 20_000) -> tuple[Forest | None, float]:
    """The forest from all labelled rows of one half, and the threshold from all of the other.

    most_local: up to so many labelled rows the driver takes them all; beyond, tasks draw, sum and count them."""
    rows = materialise(learned_rows(stats, marks), "labelled-rules")
    sizes = {(r["half"], r["quality"]): r["count"] for r in rows.groupBy("half", "quality").count().collect()}
    if sum(sizes.values()) <= most_local:
        got = rows.toPandas()
        order = [crc32(str(d).encode()) for d in got["doc_id"]]  # so that halves don't follow the ids
        got = got.assign(order=order).sort_values(["order", "doc_id"], kind="stable")
        x, q = np.array(got["rules"].tolist(), dtype=float).reshape(-1, len(RULES)), got["quality"].to_numpy()
        if any(not (q[half::2] == k).any() for half in (0, 1) for k in (0, 1)):
            return None, math.inf
        forest = grow(x[::2], np.quantile(x[::2][q[::2] == 1], [0.005, 0.5, 0.995], axis=0), trees, subsample, seed=seed)
        a, q = forest.score(x[1::2]), q[1::2]
        cells = pd.DataFrame({"low": a, "high": a, "good": q == 1, "bad": q == 0}).groupby("low", as_index=False).agg({"high": "max", "good": "sum", "bad": "sum"})
        return forest, threshold(cells, false_rejects)
    if any(not sizes.get((half, k)) for half in (0, 1) for k in (0, 1)):
        return None, math.inf
    first, second = rows.where("half = 0"), rows.where("half = 1 AND quality IN (0, 1)")
    n = sum(v for (half, _), v in sizes.items() if half == 0)
    forest = grow(tree_rows(first, n, trees, subsample, seed), _spread(first.where("quality = 1")), trees, subsample, seed=seed)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"quality": b["quality"], "score": forest.score(np.array(b["rules"].tolist(), dtype=float).reshape(-1, len(RULES)))})

    cells = second.select("quality", "rules").mapInPandas(scored, "quality long, score double").groupBy((F.col("score") * 1_000_000).cast("long").alias("cell"))
    counts = [F.sum((F.col("quality") == k).cast("long")).alias(name) for k, name in ((1, "good"), (0, "bad"))]
    return forest, threshold(cells.agg(F.min("score").alias("low"), F.max("score").alias("high"), *counts).toPandas(), false_rejects)


def quality_rules(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """doc_id, the BASE counts, base_failed, kept, anomaly for each row of docs (doc_id, text); marks: doc_id, quality."""
    small_batches(docs.sparkSession)
    stats = materialise(statistics(docs), "rule-statistics")
    forest, limit = fit(stats, marks, **options)

    @F.pandas_udf("double")
    def anomaly(rules: pd.Series) -> pd.Series:
        x = np.array(rules.tolist(), dtype=float).reshape(-1, len(RULES))
        return pd.Series(forest.score(x) if forest else np.zeros(len(x)))

    out = stats.withColumn("anomaly", anomaly("rules"))
    return out.select("doc_id", *BASE, F.col("failed").alias("base_failed"), (~F.col("failed") & ~(F.col("anomaly") > limit)).alias("kept"), "anomaly")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
