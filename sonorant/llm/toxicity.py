"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learns from at most `per_class` labelled ids of each class, chosen by a hash of the id among the training folds;
scoring reads every text whole. Features are the hashed unigrams, bigrams and skip-grams that a text
holds (2^bits slots); FTRL keeps per-coordinate learning rates and its L1 term leaves few weights, so the broadcast
model is compact and of bounded size.

Defined cases: a null or empty text has only the bias; without labelled rows every score is 0.5, and with one class
all scores lean to it; of rows that share a labelled id one is learned from; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, id_in, id_out, labels, small_batches

_LETTERS = re.compile(r"[^\W\d_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HEADS = (4, 5, 6, 7, 8)


class Vocabulary:
    """Hashes of words and of their heads (first letters, n-grams anchored at a word's start), of bounded size."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.word = np.zeros(1 << 14, dtype=np.uint64)
        self.heads = np.zeros((1 << 14, len(_HEADS)), dtype=np.uint64)

    def learn(self, words: list[str]) -> None:
        for w in words:
            k = len(self.index)
            if k >= len(self.word):
                self.word, self.heads = np.concatenate([self.word, np.zeros_like(self.word)]), np.concatenate([self.heads, np.zeros_like(self.heads)])
            self.index[w] = k
            self.word[k] = xxhash.xxh64_intdigest(w)
            self.heads[k] = [xxhash.xxh64_intdigest(w[:n], seed=n) if len(w) > n else 0 for n in _HEADS]

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.forget()
        try:
            return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            self.learn(list(dict.fromkeys(w for w in words if w not in self.index)))
            return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))


_VOCABULARY = Vocabulary()


def features(text: str | None, bits: int = 20, skip: int = 2) -> np.ndarray:
    """Sorted distinct slots of the text's unigrams, word heads, bigrams and skip-grams with up to `skip` words between."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, dtype=np.int64)
    at = _VOCABULARY(words)
    h = _VOCABULARY.word[at]
    heads = _VOCABULARY.heads[np.unique(at)].ravel()
    parts = [h * _M1, heads[heads > 0] * _M3]
    with np.errstate(over="ignore"):
        parts += [(h[:-d] * _M2 ^ h[d:]) * _M3 + np.uint64(d) * _M1 for d in range(1, skip + 2) if len(h) > d]
    slots = np.concatenate([(p ^ (p >> np.uint64(29))) * _M2 >> np.uint64(64 - bits) for p in parts])
    return np.unique(slots).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss with L1 and L2."""

    def __init__(self, slots: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 2.0, l2: float = 0.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)  # the last is the bias, which has no L1

    def weights(self, at: np.ndarray, l1: float) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        bias = np.array([len(self.z) - 1])
        w, b = self.weights(at, self.l1), self.weights(bias, 0.0)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum() + b.sum())))))
        g = p - label
        for where, old in ((at, w), (bias, b)):
            n = self.n[where]
            s = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
            self.z[where] += g - s * old
            self.n[where] = n + g * g

    def model(self) -> tuple[np.ndarray, float]:
        every = np.arange(len(self.z) - 1)
        return self.weights(every, self.l1).astype(np.float32), float(self.weights(np.array([len(self.z) - 1]), 0.0)[0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, marks: DataFrame, per_class: int = 2500, bits: int = 20, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights and the bias from at most per_class training ids of each class, one row of each id.

    The rows stream through one task in an order that a hash gives for each epoch, a batch in memory at a time; only the
    weights that are not zero (2^bits at most) come back.
    """
    marks = marks.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"))
    chosen = marks.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(marks.where("toxic = 0").orderBy(*order).limit(per_class))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "slots": [features(t, bits).astype("<i4").tobytes() for t in b["text"]]})

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner = Ftrl(1 << bits)
        for b in batches:
            for s, y in zip(b["slots"], b["toxic"].tolist(), strict=True):
                learner.learn(np.frombuffer(s, "<i4").astype(np.int64), y)
        w, bias = learner.model()
        at = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.append(at, -1), "weight": np.append(w[at].astype(float), bias)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInPandas(hashed, "doc_id long, toxic int, slots binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "slots")).alias("r")).select("doc_id", "r.*", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    rows = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", "epoch", F.lit(seed)), "doc_id")
    got = rows.select("toxic", "slots").mapInPandas(learned, "slot long, weight double").toPandas()
    real = got[got["slot"] >= 0]
    return real["slot"].to_numpy(), real["weight"].to_numpy(dtype=np.float32), float(got.loc[got["slot"] < 0, "weight"].sum())


def toxicity(docs: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); marks: doc_id, toxic."""
    small_batches(docs.sparkSession)
    bits = options.get("bits", 20)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, marks, **options))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, values, b = model.value
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[where] = values
        for x in batches:
            z = np.array([b + float(dense[features(t, bits)].sum(dtype=float)) for t in x["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": x["doc_id"], "held_out": x["held_out"], "score": 1 / (1 + np.exp(-np.clip(z, -35, 35)))})

    out = id_out(docs.select(id_in("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(scored, "doc_id string, held_out boolean, score double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
