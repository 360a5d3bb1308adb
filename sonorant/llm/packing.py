"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents become token ids with an end id; only a document longer than a sequence is cut. Each task packs its pieces by
best fit, longest first, and emits bins that are nearly full. Bins left underfull become items themselves: groups of
them are packed again by best fit, level by level up a tree, while the fill that lets a bin go falls with each level.

What moves up stays small whatever the lengths are. Best fit leaves a group at most one bin that is no more than half
full, and a bin over half full can only take such bins; so a group hands on its half empty bin and, of the others, the
`handed` ones with most room that the smallest open bin of all would still fit into. The rest are done. Levels move
rows of a bin and its fill; where bins went is composed over the levels, and the pieces are joined with that once.

Defined cases: a null or empty text is the end id alone, one piece of length 1; repeated rows are packed as separate
documents; a null doc_id is kept as null; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, id_in, id_out, materialise, small_batches

_ENCODERS: dict[str, Encoder] = {}
#: Below this code point a character is its own normal form, has no context in lower case and is told apart here.
_PLAIN = 0x250
_NOT_PLAIN = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]|<\\|")
_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_MOST_BYTES = 40  # units that are merged here; longer ones are left to the tokenizer
_NEVER = np.int32(2**31 - 1)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c))[0] == kind)


#: Fixed value: the tokenizer's own split, for plain characters in lower case.
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{re.escape(_SPACE)}{_class('L')}{_class('N')}]+")


class Merges:
    """Byte-pair merging of many units at once, one merge a unit and round: the lowest rank, leftmost of equal ones."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        letter = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        self.inner, self.last = (np.array([vocab[letter[b] + s] for b in range(256)], dtype=np.int64) for s in ("", "</w>"))
        self.base = len(vocab)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = np.argsort(key, kind="stable").astype(np.int32)
        self.key = key[self.rank]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.base + b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], _NEVER)

    def of_one_length(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) of units given as a matrix of bytes, by the number of ids."""
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rows, ranks = np.arange(len(raw)), self.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            low = ranks[every, at]
            over = low == _NEVER
            if over.any():
                yield rows[over], ids[over]
                go = ~over
                rows, ids, ranks, at, low, every = rows[go], ids[go], ranks[go], at[go], low[go], every[: int(go.sum())]
            if not len(rows):
                return
            left = np.arange(ids.shape[1] - 1) <= at[:, None]
            ids = np.where(left, ids[:, :-1], ids[:, 1:])
            ids[every, at] = self.merged[low]
            ranks = np.where(left[:, :-1], ranks[:, :-1], ranks[:, 1:])
            for side in (-1, 0):  # the pairs before and after the new id
                p = at + side
                ok = (p >= 0) & (p < ranks.shape[1])
                e, p = every[ok], p[ok]
                ranks[e, p] = self.ranks(ids[e, p], ids[e, p + 1])
        yield rows, ids


class _Known(dict):
    """The number of each unit; a new one gets the next number and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str | bytes] = []

    def __missing__(self, unit: str | bytes) -> int:
        k = self[unit] = len(self)
        self.new.append(unit)
        return k


class Encoder:
    """Token ids of texts, with a bounded memory of the ids of units.

    Units are what the tokenizer itself splits a text of plain characters into before merging, or else the chunks
    between ASCII white space, which it drops and never merges across; so a text's ids are its units' ids in order.
    """

    def __init__(self, path: str, most: int = 700_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.most = Tokenizer.from_file(path), Merges(path), most
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int64)

    def learn(self) -> None:
        """Find the ids of the units that were new since the last call."""
        units, self.known.new = self.known.new, []
        if not units:
            return
        first, raws = len(self.known) - len(units), [u.encode() if isinstance(u, str) else b"" for u in units]
        n = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        short = (n > 0) & (n <= _MOST_BYTES)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in np.unique(n[short]).tolist():
            rows = np.flatnonzero(n == k)
            matrix = np.frombuffer(b"".join([raws[i] for i in rows.tolist()]), dtype=np.uint8).reshape(-1, k)
            found += [(rows[r], ids) for r, ids in self.merges.of_one_length(matrix)]
        rest = np.flatnonzero(~short).tolist()
        if rest:
            texts = [u if isinstance(u, str) else u.decode("utf-8", "replace") for u in (units[i] for i in rest)]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            for size in sorted(set(map(len, encoded))):
                rows = [i for i, ids in enumerate(encoded) if len(ids) == size]
                found.append((np.array([rest[i] for i in rows]), np.array([encoded[i] for i in rows], dtype=np.int64).reshape(len(rows), size)))
        total = sum(ids.size for _, ids in found)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        for rows, ids in found:
            self.flat[self.used : self.used + ids.size] = ids.ravel()
            self.start[first + rows], self.size[first + rows] = self.used + np.arange(len(rows)) * ids.shape[1], ids.shape[1]
            self.used += ids.size

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held, size = [], 0
        for t in texts:  # some at once, so that what is new is learned in one call
            held.append(t)
            size += len(t or "")
            if size > 400_000:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.known) > self.most:
            self.forget()
        get = self.known.__getitem__
        at, count = [], []
        for t in texts:
            units = self.units(t)
            count.append(len(units))
            at.append(np.fromiter(map(get, units), dtype=np.int64, count=len(units)))
        self.learn()
        if not at:
            return
        at = np.concatenate(at)
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *count])].tolist()
        for a, z in zip(cuts, cuts[1:]):
            yield flat[a:z]

    @staticmethod
    def units(text: str | None) -> list[str] | list[bytes]:
        t = text or ""
        if _NOT_PLAIN.search(t) is None:  # special tokens keep their case
            return _UNITS.findall(t.lower())
        return t.encode("utf-8", "replace").split()


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, limit: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """doc_id (as a string, for the way through Python), piece, start, length, ids_crc32 of each piece."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        for b in batches:
            rows = []
            for d, ids in zip(b["doc_id"], encode(list(b["text"])), strict=True):
                ids = np.concatenate([ids, end], dtype="<u4")
                rows += [(d, i, s, min(limit, len(ids) - s), zlib.crc32(ids[s : s + limit])) for i, s in enumerate(range(0, len(ids), limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_in("doc_id"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin and offset, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    where, offset, fill = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    free: list[list[int]] = [[] for _ in range(limit + 1)]  # bins by the room they have
    rooms = 0  # bit r: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = limit, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            free[room].append(b)
            rooms |= 1 << room
    return where, offset, np.asarray(fill, dtype=np.int64)


def handed_on(fill: np.ndarray, limit: int, least: int, handed: int) -> np.ndarray:
    """Which open bins go on to the next level: those at most half full, and of the others those with most room, `handed`
    at most, whose room the smallest open bin of all (least) would fit into."""
    half = 2 * fill <= limit
    more = np.flatnonzero(~half & (limit - fill >= least))
    out = half.copy()
    out[more[np.argsort(fill[more], kind="stable")[:handed]]] = True
    return out


def pack(docs: DataFrame, limit: int = 4096, end_id: int = 1, tokenizer: str | None = None, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs (doc_id, text); options: place's."""
    small_batches(docs.sparkSession)
    return id_out(place(materialise(pieces(docs, limit, end_id, tokenizer), "pieces"), limit, **options))


def place(cut: DataFrame, limit: int, local: int = 60_000, fan_in: int = 16, handed: int = 1024, nearly_full: tuple[float, ...] = (0.995, 0.99, 0.98, 0.97, 0.95)) -> DataFrame:
    """cut (rows with a length; other columns pass through pandas) with sequence_id and offset.

    local: pieces that a task packs together; fan_in: groups that meet at a level; handed: bins over half full that a
    group hands on; nearly_full: the fill, as a share of limit, from which a bin is done at each level (the last one
    holds from there on).
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed() -> pd.DataFrame:
            x = pd.concat(held, ignore_index=True)
            where, offset, fill = best_fit(x["length"].to_numpy(), limit)
            # The smallest open bin of all is not known yet: one of another task may fit where none of this one does.
            go = (fill < done(0)) & handed_on(fill, limit, 1, handed)
            base = (task << 40) + (chunk << 24)
            return x.assign(sequence_id=base + where, offset=offset, fill=np.where(go[where] & (offset == 0), fill[where], 0))

        for b in batches:
            held.append(b)
            size += len(b)
            if size >= local:
                yield packed()
                held, size, chunk = [], 0, chunk + 1
        if size:
            yield packed()

    def again(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bin", kind="stable")
        bins, old = x["bin"].to_numpy(), x["fill"].to_numpy()
        where, offset, fill = best_fit(old, limit)
        head = bins[np.unique(where, return_index=True)[1]] if len(bins) else bins
        go = (fill < done(level)) & handed_on(fill, limit, least, handed)
        return pd.DataFrame({"bin": bins, "to": head[where], "at": offset, "fill": np.where(go[where] & (bins == head[where]), fill[where], 0)})

    def done(at: int) -> int:
        return int(limit * nearly_full[min(at, len(nearly_full) - 1)])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    placed = materialise(cut.mapInPandas(first, f"{shape}, sequence_id long, offset long, fill long"), "packed")
    open_bins = placed.where("fill > 0").select(F.col("sequence_id").alias("bin"), "fill")
    groups, level, moves = max(1, placed.rdd.getNumPartitions()), 0, None
    while True:
        groups, level = -(-groups // fan_in), level + 1
        least = open_bins.agg(F.min("fill")).first()[0] or limit
        group = F.pmod(F.xxhash64("bin"), F.lit(groups))
        moved = materialise(open_bins.groupBy(group.alias("g")).applyInPandas(again, "bin long, to long, at long, fill long"), f"pack-level{level}")
        step = moved.where("bin <> to OR at <> 0").select(F.col("bin").alias("to"), F.col("to").alias("next"), F.col("at").alias("more"))
        if moves is None:
            moves = step.select(F.col("to").alias("bin"), F.col("next").alias("to"), F.col("more").alias("at"))
        else:  # a bin that moved moves on with the one that took it
            on = moves.join(step, "to", "left").select("bin", F.coalesce("next", "to").alias("to"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
            own = step.join(moves.select(F.col("bin").alias("to")), "to", "left_anti").select(F.col("to").alias("bin"), F.col("next").alias("to"), F.col("more").alias("at"))
            moves = materialise(on.unionByName(own), f"pack-moves{level}")
        if groups == 1:
            break
        open_bins = moved.where("fill > 0").select("bin", "fill")
    out = placed.drop("fill").join(moves.withColumnsRenamed({"bin": "_bin", "to": "_to", "at": "_at"}), F.col("sequence_id") == F.col("_bin"), "left")
    return out.select(*[c for c in cut.columns], F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_at", F.lit(0))).alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
