"""Quality classifier: interpolated modified Kneser-Ney n-gram model trained on trusted text.

The model's tokens are words, in trigrams, with one event for a word that repeats the word before it. Below the words' own
distribution lies their spelling, a Kneser-Ney model of character classes (48, order 4), which gives words that were
never seen a probability. Every trusted text is counted whole, and no word or n-gram is left out.

Counts are joined with the documents' n-grams in shards by an n-gram's middle word, so that contexts, pairs and
continuation counts of an n-gram are in one shard; frequent words are dealt over several. N-grams travel as word numbers,
in several passes over the documents, each with its part of the shards. The words themselves (20 bytes each, with
their probability without context) and the spelling table (21 MB, compressed) go to all tasks.

A document's perplexity per symbol is smoothed towards its language's trusted mean (`prior` symbols), so a very short
text is not judged on a few letters. It is rejected above its language's quantile plus a margin; the quantile is that of
trusted documents that were not trained on.

Defined cases: a null or empty text has the language's mean perplexity and is kept; a null language is a language of its
own; a language without held-out trusted rows uses the quantile of all held-out ones, or if there are none of all
trusted ones; trusted rows without text set no quantile; without others all is kept; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import discard, documents, labels, materialise, small_batches, trim

N_CLASSES, ORDER = 48, 4
_WORDS, _BUCKETS = 1_200_000, 16
_SLICE = 100_000  # entries that are worked on at once where arrays beside the result would be as long as it
_SPELLED = 20_000  # words whose characters are looked up at once
_GROUPS = {31: ".", 32: ",", 33: ";:", 34: "!", 35: "?", 36: "'\"", 37: "()[]{}", 38: "-_", 39: "|", 40: "#*$%&<>", 42: "=@/+"}
_TOKENS = re.compile(r"\s+|\S+")


def _classes() -> np.ndarray:
    """The class of each code point below 0x250; 0 is the text's edge, 47 whatever else."""
    t = np.full(0x250, 47, dtype=np.uint8)
    for c in range(0x80, 0x250):
        if chr(c).isalpha():
            t[c] = 30 if chr(c).isupper() else 43 + c % 4
    t[32:127] = 41
    t[[9, 32]], t[[10, 13]] = 1, 2
    t[48:58], t[65:91], t[97:123] = 3, 30, np.arange(4, 30)
    for k, chars in _GROUPS.items():
        t[[ord(c) for c in chars]] = k
    return t


_CLASS = _classes()
#: No letters are assigned from here on.
_END = 0x40000
_LETTERS = (*range(4, 30), *range(43, 47))


@cache
def _far_classes() -> np.ndarray:
    """The class of each code point from 0x250 to _END: letters and marks of other scripts are spread over all letter classes."""
    t = np.full(_END + 1 - 0x250, 47, dtype=np.uint8)
    for c in range(0x250, _END):
        x = chr(c)
        if x.isupper():
            t[c - 0x250] = 30
        elif x.isalpha() or (unicodedata.category(x)[0] == "M" and not 0xFE00 <= c <= 0xFE0F):  # no variation selectors
            t[c - 0x250] = _LETTERS[c % len(_LETTERS)]
        elif x.isdecimal():
            t[c - 0x250] = 3
        elif x.isspace():
            t[c - 0x250] = 1
    return t


def classes_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    out = _CLASS[np.minimum(points, 0x24F)]
    far = points > 0x24F
    if far.any():
        out[far] = _far_classes()[np.minimum(points[far], _END) - 0x250]
    return out


def reduced(text: str | None) -> tuple[str, int, int]:
    """The text without words that repeat the one before, how many those were, and the number of words."""
    t = text or ""
    words = t.split()
    repeats = sum(map(str.__eq__, words, words[1:]))
    if not repeats:
        return t, 0, len(words)
    out, last, gap = [], None, ""
    for x in _TOKENS.findall(t):
        if x.isspace():
            gap = x
        else:
            if x != last:
                out += [gap, x]
                last = x
            gap = ""
    return "".join(out), repeats, len(words)


def ngrams(text: str) -> np.ndarray:
    """The code of the n-gram that ends at each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.concatenate([np.zeros(ORDER - 1, dtype=np.int32), classes_of(points).astype(np.int32)])
    code = np.zeros(len(points), dtype=np.int32)
    for k in range(ORDER):
        code = code * N_CLASSES + s[k : k + len(points)]
    return code


def probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(last symbol | the three before) for each code, from the counts of all codes."""
    levels = [counts.reshape(-1, N_CLASSES)]
    for _ in range(ORDER - 1):  # lower orders count distinct continuations
        levels.append((levels[-1].reshape(N_CLASSES, -1) > 0).sum(axis=0).reshape(-1, N_CLASSES))
    p = np.full((1, N_CLASSES), 1 / (N_CLASSES - 1), dtype=np.float32)
    p[0, 0] = 0.0  # no symbol is the text's edge
    for c in reversed(levels):
        n = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        d = [0.0] + [min(float(k), max(0.0, k - (k + 1) * y * n[k] / max(n[k - 1], 1))) for k in (1, 2, 3)]
        off = np.asarray(d, dtype=np.float32)[np.minimum(c, 3)]
        total = c.sum(axis=1, keepdims=True)
        low = np.tile(p, (c.shape[0] // p.shape[0], 1))
        spare = np.where(total > 0, off.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0).astype(np.float32)
        p = c.astype(np.float32)
        p -= off
        del off
        p /= np.maximum(total, 1).astype(np.float32)
        low *= spare
        p += low
    return np.log(np.maximum(p, 1e-12)).ravel()


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the n-grams of each word's characters and the space after it, none of which sees the word before; and where words begin in them."""
    points = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    begin = np.cumsum(size) - size
    at = np.arange(len(points)) - np.repeat(begin, size)
    s = np.concatenate([np.zeros(ORDER - 1, dtype=np.int32), classes_of(points).astype(np.int32)])
    code = np.zeros(len(points), dtype=np.int32)
    for k in range(ORDER):
        back = ORDER - 1 - k
        code = code * N_CLASSES + np.where(at >= back, s[k : k + len(points)], 0)
    return code, begin


class Shared:
    """Arrays for all tasks as byte planes, compressed: Spark writes a Python broadcast to the disk of the driver and of every executor."""

    def __init__(self, spark: SparkSession, kind: type, *arrays: np.ndarray) -> None:
        self.kind, self.sent = kind, spark.sparkContext.broadcast(_pack(*arrays))

    def value(self):
        if "got" not in self.__dict__:
            self.got = self.kind(*_unpack(self.sent.value))
        return self.got

    def __getstate__(self) -> dict:
        return {"kind": self.kind, "sent": self.sent}

    def destroy(self) -> None:
        self.sent.destroy()


class Numbers(dict):
    """Numbers for words as they come. Nothing in it refers to itself, so a block's words go with it and wait for no collection of cycles."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def of(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """The numbers of the text's words without those that repeat the one before, how many those were, and its symbols: characters without repeated words, and one for each of these."""
        words = (text or "").split()
        x = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        again = np.flatnonzero(x[1:] == x[:-1]) + 1
        n = len(again)
        if not n:
            return x, 0, len(text or "")
        return np.delete(x, again), n, len(text) - sum(len(words[i]) for i in again.tolist())


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


EDGE, UNKNOWN, FIRST = 0, 1, 2  # numbers of the text's edge, of all words that were not trained, and of the most frequent word


class Words(NamedTuple):
    """The trained words, by hash, and their numbers; and the shards that count and score n-grams (u, v, w).

    The shard is that of v, so that contexts (u, v) and (v) and pairs (v, w) are whole in it. A frequent v is dealt by u over as many
    shards as its share asks for; how many words come before its pairs is then summed.
    """

    hash: np.ndarray  # in order
    number: np.ndarray
    parts: np.ndarray  # shards of each number below len(parts); other words have one
    n: np.ndarray  # all shards

    @property
    def n_shards(self) -> int:
        return int(self.n[0])

    def find(self, words: list[str]) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(words), UNKNOWN, dtype=np.int32)
        h = hashes(words)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.number[at], UNKNOWN).astype(np.int32)

    def shard(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        if len(u) > _SLICE:
            return np.concatenate([self.shard(u[i : i + _SLICE], v[i : i + _SLICE]) for i in range(0, len(u), _SLICE)])
        out = (_mixed(v) % np.uint64(self.n_shards)).astype(np.int32)
        yes = np.flatnonzero(v < len(self.parts))
        if len(yes):
            out[yes] = (out[yes] + (_mixed(u[yes] ^ 0x5BD1E995) % self.parts[v[yes]].astype(np.uint64)).astype(np.int32)) % self.n_shards
        return out

    def shards_of(self, v: int) -> list[int]:
        first = int(_mixed(np.array([v]))[0] % np.uint64(self.n_shards))
        return sorted({(first + j) % self.n_shards for j in range(int(self.parts[v]))})


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, compressed."""
    out = [np.array([len(columns), *[len(c) for c in columns]], dtype="<i8").tobytes(), "".join(c.dtype.str for c in columns).encode()]
    out += [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.compress(b"".join(out), 1)


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(payload)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    size = np.frombuffer(raw, "<i8", k, 8).tolist()
    at = 8 + 8 * k
    kinds = re.findall("...", raw[at : at + 3 * k].decode())
    at, out = at + 3 * k, []
    for n, kind in zip(size, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _id(held: list[tuple[int, bool, np.ndarray]]) -> np.ndarray:
    """A number for some rows, by their keys."""
    return np.frombuffer(hashlib.sha256(np.array([k for k, _, _ in held], dtype="<i8").tobytes()).digest()[:8], "<i8")


def _block(held: list[tuple[int, bool, np.ndarray]], number: np.ndarray, words: Words, part: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """shard, payload of the n-grams of some texts (key, trained, places of their words in number); those after a word that was not trained have no context and are left out."""
    size = np.array([len(x) + 1 for _, _, x in held])
    s = np.concatenate([number[np.append(-1, x)] for _, _, x in held])
    s[np.cumsum(size) - size] = EDGE
    row = np.repeat(np.arange(len(held), dtype=np.int32), size)
    at = np.flatnonzero((s[1:-1] != EDGE) & (s[1:-1] != UNKNOWN) & (s[2:] != EDGE)) + 2
    shard = words.shard(s[at - 2], s[at - 1])
    if parts > 1:
        mine = shard % parts == part
        at, shard = at[mine], shard[mine]
    by = np.argsort(shard.astype(np.uint16) if words.n_shards <= 1 << 16 else shard, kind="stable")  # 16 bits are sorted by counting
    at, shard = at[by], shard[by]
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
    flags, block = np.array([t for _, t, _ in held], dtype="|u1"), _id(held)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        x, r = at[i:j], row[at[i:j]]
        new = np.append(True, r[1:] != r[:-1])
        yield int(shard[i]), _pack(block, np.diff(r[new], prepend=0).astype("<u4"), flags[r[new]], new.astype("|u1"), *[s[y].astype("<u4") for y in (x - 2, x - 1, x)])


def _words(steps: np.ndarray, *rest: np.ndarray) -> Words:
    return Words(np.cumsum(steps, dtype=np.uint64), *rest)


class Lowest(NamedTuple):
    """log P of words without context, by number, and of the first words of texts; an unknown word has its spelling times `unknown`."""

    spelling: np.ndarray
    known: np.ndarray
    first: np.ndarray  # 0 for words that no trained text begins with
    rest: np.ndarray  # log of what is left for unknown words, for those that begin no text, and the cost of a repeated word


def messages(docs: DataFrame, words: Shared, lowest: Shared | None = None, part: int = 0, parts: int = 1) -> DataFrame:
    """shard, own, payload: the n-grams of the words of docs (key, trained, text), for each shard whose number is `part` modulo
    `parts`. With `lowest`, also the keys of each block of rows, and in part 0 their symbols and the -log P of what needs no shard."""

    def parts_of(held: list, sizes: list, known: Numbers) -> pd.DataFrame:
        w, names = words.value(), list(known)
        number = w.find(names)
        out = [(shard, True, x) for shard, x in _block(held, number, w, part, parts)]
        if not lowest:
            return pd.DataFrame(out, columns=["shard", "own", "payload"])
        base, r = np.zeros(len(held)), np.array(sizes, dtype="<i8")
        if part == 0:
            low = lowest.value()
            p = low.known[number].astype(float)
            new = np.flatnonzero(number == UNKNOWN)
            for i in range(0, len(new), _SPELLED):
                code, begin = spelled([names[k] for k in new[i : i + _SPELLED].tolist()])
                p[new[i : i + _SPELLED]] = np.add.reduceat(low.spelling[code].astype(float), begin)
            p[new] += low.rest[0]
            first = np.where(low.first[number] < 0, low.first[number], low.rest[1] + p)
            for i, (_, _, x) in enumerate(held):
                # An unknown word's spelling, and words after an unknown one, are settled here.
                y = number[x]
                here = y == UNKNOWN
                here[1:] |= y[:-1] == UNKNOWN
                base[i] = -p[x[1:]][here[1:]].sum() - first[x[0]]
            base += r[:, 0] * low.rest[2]
        keys, block = np.array([k for k, _, _ in held], dtype="<i8"), _id(held)
        out.append((int(block[0]) % -(-w.n_shards // parts) * parts, False, _pack(block, keys, base, r[:, 1] * int(part == 0))))
        return pd.DataFrame(out, columns=["shard", "own", "payload"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sizes, known, n = [], [], Numbers(), 0
        for b in batches:
            for k, t, text in zip(b["key"].tolist(), b["trained"].tolist(), b["text"], strict=True):
                x, again, symbols = known.of(text)
                if len(x):
                    held.append((k, t, x))
                    sizes.append((again, symbols))
                    n += len(x)
                if n >= _WORDS:
                    yield parts_of(held, sizes, known)
                    held, sizes, known, n = [], [], Numbers(), 0
                    trim()
        if held:
            yield parts_of(held, sizes, known)
        held, sizes, known = [], [], Numbers()
        trim()

    return docs.select("key", "trained", "text").mapInPandas(rows, "shard int, own boolean, payload binary")


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each entry's among them: np.unique with less memory."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    place = np.empty(len(x), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


class Grams:
    """The different n-grams of a shard's payloads in the order of (v, u, w), their contexts (u, v) and pairs (v, w), and the trained counts.

    What has an entry for each n-gram has 32 bits wherever it can, and goes when it is used up.
    """

    def __init__(self, payloads: list[bytes], n: int) -> None:
        keys, counts = [], []
        self.rows = []  # of each payload: the block and its rows, and each n-gram's row and place among the payload's different ones
        narrow = n < 1 << 21
        for p in payloads:
            block, steps, flag, new, u, v, w = _unpack(p)
            row = np.cumsum(new, dtype=np.int32) - 1
            if narrow:
                k, at = ranked((v.astype(np.int64) << 42) | (u.astype(np.int64) << 21) | w)
            else:
                vu, at = ranked((v.astype(np.int64) << 32) | u)
                k, at = ranked(at.astype(np.int64) * n + w)
                k = np.stack([vu[k // n] >> 32, vu[k // n] & 0xFFFFFFFF, k % n]).astype(np.int32)
            keys.append(k)
            counts.append(np.bincount(at[flag[row] > 0], minlength=k.shape[-1]).astype(np.int32))
            self.rows.append((int(block[0]), np.cumsum(steps, dtype=np.int64), row, at))
        if narrow:
            key = np.concatenate(keys)
            keys.clear()
            triple, self.place = ranked(key)
            del key
            new = np.diff(triple >> 21, prepend=-1) != 0
            v, w = (triple >> 42).astype(np.int32), (triple & 0x1FFFFF).astype(np.int32)
            self.context = np.cumsum(new, dtype=np.int32) - 1
            self.n_contexts = int(new.sum())
        else:
            v, u, w = np.concatenate(keys, axis=1)
            keys.clear()
            vu, context = ranked((v.astype(np.int64) << 32) | u)
            del v, u
            triple, self.place = ranked(context.astype(np.int64) * n + w)
            del context
            self.context, w = (triple // n).astype(np.int32), (triple % n).astype(np.int32)
            v = (vu >> 32).astype(np.int32)[self.context]
            self.n_contexts = len(vu)
        self.count, begin = np.zeros(len(triple), dtype=np.int64), 0
        del triple
        for c in counts:  # a payload's n-grams differ from each other
            self.count[self.place[begin : begin + len(c)]] += c
            begin += len(c)
        del counts
        pair, self.pair = ranked((v.astype(np.int64) << 32) | w)
        del v, w
        self.v, self.w = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        #: How many different words come before a pair.
        self.follows = np.bincount(self.pair[self.count > 0], minlength=len(pair))


def tally(counts: np.ndarray) -> np.ndarray:
    """How many of the counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2 and from 3 on."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    d = [min(float(k), max(0.0, k - (k + 1) * y * n[k] / max(n[k - 1], 1))) for k in (1, 2, 3)]
    return np.array([0.0, *[x or 0.5 for x in d]])  # no discount would leave what was not seen without any probability


def counted(payloads: list[bytes], words: Words, n: int) -> list[tuple[int, int, bytes]]:
    """kind, bucket, payload of what a shard's trained n-grams add to the model: 0: tallies of triples and pairs; 1: words
    with the number of pairs they end, by bucket; 2: a frequent word's pairs, with the number of words before each."""
    g = Grams(payloads, n)
    split = g.v < len(words.parts)
    out = [(0, 0, _pack(np.concatenate([tally(g.count), tally(g.follows[~split])])))]
    w, ends = np.unique(g.w[~split], return_counts=True)
    out += [(1, b, _pack(w[w % _BUCKETS == b], ends[w % _BUCKETS == b])) for b in range(_BUCKETS)]
    for v in np.unique(g.v[split]).tolist():
        x = np.flatnonzero(g.v == v)
        out.append((2, v, _pack(g.w[x], g.follows[x])))
    return out


def summed(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """The first columns' values in order, and the sums of the others' for each."""
    parts = [_unpack(p) for p in payloads]
    k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return k, *[np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(k)).astype(np.int64) for i in range(1, len(parts[0]))]


def _sums(of: np.ndarray, counts: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The total of each context's counts, and what their discounts sum to."""
    return np.bincount(of, weights=counts, minlength=n), np.bincount(of, weights=d[np.minimum(counts, 3)], minlength=n)


def level(c: np.ndarray, d: np.ndarray, total: np.ndarray, spare: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log P at one order from that at the next lower one."""
    some = np.maximum(total, 1)
    with np.errstate(divide="ignore"):
        return np.where(total > 0, np.logaddexp(np.log((c - d[np.minimum(c, 3)]) / some), np.log(spare / some) + low), low)


def levels(c: np.ndarray, d: np.ndarray, of: np.ndarray, total: np.ndarray, spare: np.ndarray, to: np.ndarray, low: np.ndarray) -> np.ndarray:
    """level() with the total and spare of the contexts `of`, and low at `to`, which are looked up a slice at a time."""
    out = np.empty(len(c))
    for i in range(0, len(c), _SLICE):
        x = slice(i, i + _SLICE)
        out[x] = level(c[x], d, total[of[x]], spare[of[x]], low[to[x]].astype(float))
    return out


def losses(payloads: list[bytes], pairs: dict[int, bytes], low: np.ndarray, d3: np.ndarray, d2: np.ndarray) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By block: rows and -log P of their n-grams in this shard; pairs: those of frequent words, whole; low: log P without context by number."""
    g = Grams(payloads, len(low))
    follows = g.follows
    v, at = ranked(g.v)
    total2, spare2 = _sums(at, follows, d2, len(v))
    for word, payload in pairs.items():  # the words before a pair of theirs are in several shards
        i = int(np.searchsorted(v, word))
        if i < len(v) and v[i] == word:
            w, c = _unpack(payload)
            total2[i], spare2[i] = c.sum(), d2[np.minimum(c, 3)].sum()
            x = np.flatnonzero(at == i)
            k = np.minimum(np.searchsorted(w, g.w[x]), len(w) - 1)
            follows[x] = np.where(w[k] == g.w[x], c[k], 0)
    p = levels(follows, d2, at, total2, spare2, g.w, low)
    del follows, at
    total3, spare3 = _sums(g.context, g.count, d3, g.n_contexts)
    p = levels(g.count, d3, g.context, total3, spare3, g.pair, p)
    del g.count, g.context, g.pair, g.follows
    out, begin = defaultdict(list), 0
    for block, rows, row, k in g.rows:
        n = int(k.max()) + 1
        out[block].append((rows, np.bincount(row, weights=-p[g.place[begin : begin + n]][k], minlength=len(rows))))
        begin += n
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task's texts: kind, code, n, payload; kind 0: character n-grams by code, 1: repeated words and all words, 2: words by bucket, with their number and that of texts that begin with them."""
    total, repeats, words = np.zeros(N_CLASSES**ORDER, dtype=np.int64), 0, 0

    def block(held: list[np.ndarray], known: Numbers) -> pd.DataFrame:
        n = np.bincount(np.concatenate(held), minlength=len(known))
        first = np.bincount([x[0] for x in held if len(x)], minlength=len(known))
        names = list(known)
        for i in range(0, len(names), _SPELLED):
            code, begin = spelled(names[i : i + _SPELLED])
            np.add.at(total, code, np.repeat(n[i : i + _SPELLED], np.diff(np.append(begin, len(code)))))
        h = hashes(names)
        bucket = (h % np.uint64(_BUCKETS)).astype(np.int64)
        out = []
        for b in range(_BUCKETS):
            x = np.flatnonzero(bucket == b)
            out.append((2, b, 0, _pack(h[x], n[x], first[x], np.frombuffer(" ".join([names[i] for i in x.tolist()]).encode("utf-8", "surrogatepass"), np.uint8))))
        return pd.DataFrame(out, columns=["kind", "code", "n", "payload"])

    held, known, size = [], Numbers(), 0
    for b in batches:
        for t in b["text"]:
            x, again, _ = known.of(t)
            held.append(x)
            size += len(x)
            repeats, words = repeats + again, words + len(x) + again
        if size > _WORDS:
            yield block(held, known)
            held, known, size = [], Numbers(), 0
            trim()
    if size:
        yield block(held, known)
    held, known = [], Numbers()
    trim()
    at = np.flatnonzero(total)
    if words:
        yield pd.DataFrame([(1, 0, repeats, None), (1, 1, words, None)], columns=["kind", "code", "n", "payload"])
        yield pd.DataFrame({"kind": np.zeros(len(at), np.int32), "code": at, "n": total[at], "payload": None})


def trusted_rows(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of docs whose id is in ids (one row an id), with the ids' other columns: by broadcast while ids are at most `most` (8 MB), else by a shuffle."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids.hint("merge"), "doc_id")


class Model(NamedTuple):
    """The counts of words; those of triples and pairs stay in the shards."""

    words: Shared
    n_shards: int
    lowest: Shared
    d2: np.ndarray
    d3: np.ndarray
    pairs: DataFrame | None  # shard, v, payload: the pairs of frequent words


def vocabulary(found: DataFrame, spelling: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, count, count as a text's first, and log P of the spelling of every trained word, the most frequent first."""
    model = found.sparkSession.sparkContext.broadcast(zstandard.compress(spelling.tobytes(), 1))

    def merged(x: pd.DataFrame) -> pd.DataFrame:
        parts, table = [_unpack(p) for p in x["payload"]], np.frombuffer(zstandard.decompress(model.value), np.float32)
        known: dict[int, str] = {}
        for p in parts:
            known.update(zip(p[0].tolist(), p[3].tobytes().decode("utf-8", "surrogatepass").split(" "), strict=True) if len(p[0]) else ())
        h, n, first = summed([_pack(*p[:3]) for p in parts])
        spell = np.zeros(len(h))
        for i in range(0, len(h), _SPELLED):
            code, begin = spelled([known[k] for k in h[i : i + _SPELLED].tolist()])
            spell[i : i + _SPELLED] = np.add.reduceat(table[code].astype(float), begin)
        return pd.DataFrame([(_pack(h, n, first, spell.astype("<f4")),)], columns=["payload"])

    got = found.where("kind = 2").groupBy("code").applyInPandas(merged, "payload binary").collect()
    model.destroy()
    columns = [np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.uint64, np.int64, np.int64, np.float32), zip(*[_unpack(r["payload"]) for r in got], strict=True) if got else [()] * 4, strict=True)]
    discard(found)
    order = np.lexsort((columns[0], -columns[1]))
    return tuple(c[order] for c in columns)


def train(docs: DataFrame, n_words: int, shard_words: int) -> Model:
    """The model of docs (key, trained, text); n_words: about those of all texts that will be judged."""
    spark = docs.sparkSession
    found = materialise(docs.select("text").mapInPandas(_count, "kind int, code long, n long, payload binary"), "counts")
    got = found.where("kind < 2").groupBy("kind", "code").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(N_CLASSES**ORDER, dtype=np.int64)
    dense[got.loc[got["kind"] == 0, "code"].to_numpy()] = got.loc[got["kind"] == 0, "n"].to_numpy()
    repeats, all_ = (int(got.loc[(got["kind"] == 1) & (got["code"] == k), "n"].sum()) for k in (0, 1))
    spelling = probabilities(dense)
    del got, dense
    h, n, first, spell = vocabulary(found, spelling)
    n_shards = max(1, -(-n_words // shard_words))
    # Words with a quarter of a shard or more are dealt in parts of half a shard at most.
    share = n / max(n.sum(), 1) * n_words / shard_words
    top = int((share > 0.25).sum()) if n_shards > 1 else 0
    order = np.argsort(h)
    words = Words(h[order], (order + FIRST).astype(np.int32), np.append(np.ones(FIRST, np.int64), np.ceil(2 * share[:top]).astype(np.int64)) if top else np.zeros(0, np.int64), np.array([n_shards]))
    sent, size = Shared(spark, _words, np.diff(words.hash, prepend=np.uint64(0)), *words[1:]), len(h) + FIRST
    del order, share, h

    def grams(x: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(counted(list(x["payload"]), sent.value(), size), columns=["kind", "bucket", "payload"])
        trim()
        return out

    def merged(x: pd.DataFrame) -> pd.DataFrame:
        k, c = summed(list(x["payload"]))
        return pd.DataFrame([(int(x["bucket"].iloc[0]), _pack(k, c), tally(c).tolist())], columns=["bucket", "payload", "tally"])

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:  # a frequent word's pairs end words too, each pair once
            for p in b["payload"]:
                w, _ = _unpack(p)
                yield pd.DataFrame([(k, _pack(x, np.ones_like(x))) for k in range(_BUCKETS) for x in [w[w % _BUCKETS == k]]], columns=["bucket", "payload"])

    kinds = materialise(messages(docs, sent).repartition(n_shards, "shard").groupBy("shard").applyInPandas(grams, "kind int, bucket long, payload binary"), "grams")
    pairs = materialise(kinds.where("kind = 2").groupBy("bucket").applyInPandas(merged, "bucket long, payload binary, tally array<long>"), "pairs")
    single = kinds.where("kind = 1").select("bucket", "payload").unionByName(pairs.select("payload").mapInPandas(ended, "bucket long, payload binary"))
    ends = np.zeros(size, dtype=np.int64)
    for r in single.groupBy("bucket").applyInPandas(merged, "bucket long, payload binary, tally array<long>").collect():
        w, c = _unpack(r["payload"])
        ends[w] = c
    t = np.zeros(8, np.int64)
    for r in kinds.where("kind = 0").select("payload").collect():
        t += _unpack(r["payload"])[0]
    for r in pairs.select("tally").collect():
        t[4:] += r["tally"]
    discard(kinds)
    # Without any pair, words are as frequent as they are.
    ends = ends if ends.any() else np.append(np.zeros(FIRST, np.int64), n)
    d1, d0 = discounts(tally(ends)), discounts(tally(first))
    some, begun = max(ends.sum(), 1), max(first.sum(), 1)
    spare1, spare0 = d1[np.minimum(ends, 3)].sum() / some, d0[np.minimum(first, 3)].sum() / begun
    whole = lambda x: np.full(size - FIRST, x)
    known, begins = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
    known[FIRST:] = level(ends[FIRST:], d1, whole(ends.sum()), whole(spare1 * some), spell.astype(float))
    x = np.flatnonzero(first)
    begins[x + FIRST] = np.logaddexp(np.log(first[x] - d0[np.minimum(first[x], 3)]) - np.log(begun), np.log(spare0) + known[x + FIRST]) if len(x) else 0.0
    rest = [np.log(y) if y > 0 else 0.0 for y in (spare1, spare0)] + [-np.log((repeats + 1) / (all_ + 2))]
    low = Shared(spark, Lowest, spelling, known, begins, np.array(rest))
    dealt = None
    if top:
        where = spark.createDataFrame([(v, s) for v in range(FIRST, FIRST + top) for s in words.shards_of(v)], "v long, shard int")
        dealt = pairs.withColumnRenamed("bucket", "v").join(F.broadcast(where), "v").select("shard", "v", "payload")
    return Model(sent, n_shards, low, discounts(t[4:]), discounts(t[:4]), dealt)


def judged(docs: DataFrame, model: Model, passes: int) -> DataFrame:
    """key, loss, n_symbols: -log P and symbols of the rows of docs (key, trained, text), summed over rows of one key.

    The shards are gone through in so many passes over docs, each of which shuffles its part of the n-grams.
    """
    words, low, n_shards, d2, d3 = model.words, model.lowest, model.n_shards, model.d2, model.d3
    passes, n_buckets = min(passes, n_shards), max(1, n_shards // 2)

    def shard(x: pd.DataFrame) -> pd.DataFrame:
        # What is known of a block's rows goes to one bucket, whatever the shard.
        out = [(int(_unpack(p)[0][0]), p) for p in x.loc[~x["own"] & x["v"].isna(), "payload"]]
        if x["own"].any():
            pairs = {int(v): p for v, p in zip(x["v"], x["payload"], strict=True) if v is not None}
            for block, parts in losses(list(x.loc[x["own"], "payload"]), pairs, low.value().known, d3, d2).items():
                out += [(block, _pack(np.array([block]), np.diff(rows, prepend=0).astype("<u4"), loss.astype("<f4"))) for rows, loss in parts]
        trim()
        return pd.DataFrame([(b % n_buckets, p) for b, p in out], columns=["bucket", "payload"])

    def bucket(x: pd.DataFrame) -> pd.DataFrame:
        keys, sums, late = {}, {}, []
        for block, *columns in map(_unpack, x["payload"]):
            b = int(block[0])
            if len(columns) == 3:
                keys[b] = columns[0]
                sums.setdefault(b, np.zeros((2, len(columns[0]))))
                sums[b] += columns[1:]
            else:
                late.append((b, *columns))
        for b, steps, loss in late:
            sums[b][0, np.cumsum(steps, dtype=np.int64)] += loss
        if not keys:
            return pd.DataFrame({"key": np.zeros(0, np.int64), "loss": np.zeros(0), "n_symbols": np.zeros(0, np.int64)})
        loss, n = np.concatenate([sums[b] for b in keys], axis=1)
        return pd.DataFrame({"key": np.concatenate([keys[b] for b in keys]), "loss": loss, "n_symbols": n.astype(np.int64)})

    out = []
    for part in range(passes):
        sent = messages(docs, words, low, part, passes).select("shard", "own", F.lit(None).cast("string").alias("v"), "payload")
        if model.pairs is not None:
            sent = sent.unionByName(model.pairs.where(F.col("shard") % passes == part).select("shard", F.lit(False).alias("own"), F.col("v").cast("string").alias("v"), "payload"))
        got = sent.repartition(-(-n_shards // passes), "shard").groupBy("shard").applyInPandas(shard, "bucket int, payload binary")
        out.append(materialise(got, f"losses{part}"))
        del sent, got
    # Blocks are those of a pass, so passes are summed by key; an equal block's rows are in its sums as often as it came.
    all_ = [df.groupBy("bucket").applyInPandas(bucket, "key long, loss double, n_symbols long") for df in out]
    got = materialise(reduce(DataFrame.unionByName, all_).groupBy("key").agg(F.sum("loss").alias("loss"), F.sum("n_symbols").alias("n_symbols")), "losses")
    for df in out:
        discard(df)
    return got


def quality_classifier(
    docs: DataFrame, marks: DataFrame, quantile: float = 0.99, margin: float = 0.08, prior: float = 100.0, held: int = 5, carry: tuple[str, ...] = (), shard_words: int = 2_000_000, passes: int = 2
) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, limit, kept for each row of docs (doc_id, text, lang); marks: doc_id, quality.

    held: one trusted id in so many, by a hash of the id, is not trained on and sets the quantiles instead; carry:
    further columns of docs to hand on, to tell rows apart; shard_words, passes: words a shard and passes over the
    documents, which bound a task's memory and what is shuffled at once.
    limit is exp(the quantile of the held-out trusted documents of the language + margin).
    """
    small_batches(docs.sparkSession)
    ids = marks.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    ids = materialise(ids.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(held)).cast("int")), "trusted-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), *carry)
    n_words = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    learned = trusted_rows(texts.select("doc_id", "text", "key"), ids.where("fold <> 0").select("doc_id")).select("key", F.lit(True).alias("trained"), "text")
    model = train(learned, n_words, shard_words)
    del learned
    marked = texts.select("doc_id", "text", "key").join(F.broadcast(ids) if ids.count() <= 8_000_000 else ids.hint("merge"), "doc_id", "left")
    loss = judged(marked.select("key", F.coalesce(F.col("fold") != 0, F.lit(False)).alias("trained"), "text"), model, passes)
    # What a key has is the sum over its rows, which have one text.
    rows = texts.drop("text")
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    each = loss.join(n, "key").select("key", (F.col("loss") / F.col("n_rows")).alias("loss"), (F.col("n_symbols") / F.col("n_rows")).cast("long").alias("n_symbols"))
    rows = rows.join(each, "key", "left").select("doc_id", "lang", F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), F.coalesce("loss", F.lit(0.0)).alias("loss"), *carry)
    rows = materialise(rows, "losses-of-rows")
    model.words.destroy()
    model.lowest.destroy()
    # Texts that were trained on are likelier than others, so they count only where there are no others.
    good = materialise(trusted_rows(rows, ids).where("n_symbols > 0"), "trusted-losses")
    if not good.where("fold = 0").isEmpty():
        good = good.where("fold = 0")
    mean = F.sum("loss") / F.greatest(F.sum("n_symbols"), F.lit(1))
    means = good.groupBy("lang").agg(mean.alias("mean"))
    whole = good.agg(mean.alias("mean_all"))

    def smooth(df: DataFrame) -> DataFrame:
        df = df.join(means.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l").join(F.broadcast(whole))
        at = F.coalesce("mean", "mean_all", F.lit(0.0))
        return df.withColumn("rate", (F.col("loss") + F.lit(prior) * at) / (F.col("n_symbols") + F.lit(prior)))

    fine = smooth(good)
    top = F.expr(f"percentile_approx(rate, {quantile}, 10000)")
    limits = fine.groupBy("lang").agg(top.alias("limit"))
    limit_all = fine.agg(top.alias("limit_all"))
    out = smooth(rows).join(limits.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").join(F.broadcast(limit_all))
    limit = F.coalesce("limit", "limit_all") + F.lit(margin)
    return out.select("doc_id", "lang", "n_symbols", F.exp("rate").alias("perplexity"), F.exp(limit).alias("limit"), F.coalesce(F.col("rate") <= limit, F.lit(True)).alias("kept"), *carry)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))
