"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or more. No pair within a group
is ever emitted; the work goes as follows.

1. Every text becomes a set of 64-bit shingle hashes. Documents with equal sets are one node. A mergeable Misra-Gries
   summary over all sets finds very frequent shingles, which come last in the shingles' order.
2. Linked sets of size n share one of their first n - ceil(0.8 n) + 1 shingles in that order. Those (shingle, node)
   rows shuffle by shingle and form inverted lists; lists of one node end here.
3. Each list takes its most central node as leader (the one whose lists are longest, as the original of a family is);
   a leader's group is all nodes of the lists it leads. Two linked nodes share a list, so they share a group. A large
   group is dealt into blocks, and each pair of blocks is searched on its own.
4. A bitmap of each set bounds overlaps from above; members that can reach no other member leave the group, and only
   the sets of those that stay are sent.
5. Each group is searched by T-occurrence queries: a heap merges the short inverted lists of the query, nodes with
   enough occurrences are probed in the long lists by binary search, and those that reach the required overlap link. Nodes
   already in the query's component are skipped, so a family of copies costs about one comparison a member.
6. Links form components; documents take the smallest doc_id of theirs.

The bound on steps 2 and 5 is the prefix bound, which loses no link: no candidates are capped or sampled.

Defined cases: null, empty or blank text has an empty set and links with nothing; under five words, the whole sequence
is one shingle; repeated rows and equal texts link; a row with a null doc_id links with equal texts only and gives its
component no id unless all ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, materialise, small_batches, trim
from sonorant.llm.components import components

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 2 << 20  # bytes of text that are hashed at once
_WORDS = 16  # least 64-bit words of a bitmap


def _rolled(h: np.ndarray, m: int) -> np.ndarray:
    """The hash of each m successive words."""
    with np.errstate(over="ignore"):
        x = np.full(len(h) - m + 1, m, dtype=np.uint64)
        for i in range(m):
            x ^= h[i : len(h) - m + 1 + i]
            x *= _P1
            x ^= x >> np.uint64(31)
        x *= _P2
        x ^= x >> np.uint64(29)
    return x


def _piece(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    begin, words = split.offsets.to_numpy(), split.values
    coded = words.dictionary_encode()
    known = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[coded.indices.to_numpy()]
    # Blank texts and blanks at a text's ends make empty words.
    empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    h, begin = np.delete(h, empty), begin - np.searchsorted(empty, begin)
    every = _rolled(h, k) if len(h) >= k else None
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, dtype=np.uint64)
            continue
        s = every[a : b - k + 1].copy() if b - a >= k else _rolled(h[a:b], b - a)
        s.sort()
        fresh = s[1:] != s[:-1]
        yield s if fresh.all() else np.concatenate([s[:1], s[1:][fresh]])


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles; whole pieces of the column are hashed at once."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + _PIECE, side="right")))
        yield from _piece(texts.slice(i, j - i), k)
        i = j


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.string()), k))


def node_of(s: np.ndarray) -> int:
    """The id of a set: 63 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") >> 1


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int = 80) -> np.ndarray | int:
    """The overlap that sets of sizes a and b need: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def _merge(held: dict[int, int], keys: np.ndarray, counts: np.ndarray, most: int) -> dict[int, int]:
    """Misra-Gries: add counts, keep `most` counters, lower them by the largest one that goes."""
    for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
        held[k] = held.get(k, 0) + c
    if len(held) <= most:
        return held
    cut = sorted(held.values(), reverse=True)[most]
    return {k: c - cut for k, c in held.items() if c > cut}


def describe(docs: DataFrame, tracked: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, node of each document, with the set's bitmap once for each task and node; and
    (node: shingle, n: count) of the frequent-shingle summaries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, parts, size = set(), {}, [], 0
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("summary", pa.bool_()), ("bits", pa.binary())])

        def count() -> dict[int, int]:
            x = np.concatenate(parts)
            parts.clear()
            x.sort()
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            c = np.diff(at, append=len(x))
            u, c = x[at[c > 1]], c[c > 1]
            if len(c) > tracked:
                least = np.partition(c, -tracked)[-tracked]
                u, c = u[c >= least], c[c >= least]
            return _merge(held, u, c, tracked)

        for b in batches:
            n, node, bits = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64), [None] * b.num_rows
            for i, s in enumerate(shingle_sets(b.column("text"))):
                n[i], node[i] = len(s), (own := node_of(s))
                if len(s) and own not in seen:
                    seen.add(own)
                    bits[i] = bitmap(s).tobytes()
                    parts.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        held, size = count(), 0
            yield pa.record_batch([b.column("doc_id"), n, node, np.zeros(len(n), dtype=bool), bits], schema=kinds)
        if parts:
            held = count()
        if held:
            keys = np.fromiter(held.keys(), dtype=np.uint64, count=len(held)).view(np.int64)
            yield pa.record_batch([pa.nulls(len(held), pa.int64()), list(held.values()), keys, np.ones(len(held), dtype=bool), pa.nulls(len(held), pa.binary())], schema=kinds)
        trim()

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n long, node long, summary boolean, bits binary")


def prefixes(docs: DataFrame, last: np.ndarray, percent: int) -> DataFrame:
    """sig, node, n: the shingles that each node must share one of, once for each task and node."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = shared.value, set()
        maybe = np.zeros(1 << 18, dtype=bool)  # by the low bits: most shingles need no search
        maybe[(frequent & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        for b in batches:
            out = []
            for s in shingle_sets(b.column("text")):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                p = len(s) - -(-percent * len(s) // 100) + 1
                near = np.flatnonzero(maybe[s.view(np.int64) & (len(maybe) - 1)])
                late = near[frequent[np.minimum(np.searchsorted(frequent, s[near]), len(frequent) - 1)] == s[near]] if len(near) else near
                if len(late):
                    s = np.concatenate([np.delete(s, late), s[late]])
                out.append((s[:p].copy(), node, len(s)))
            if out:
                first, node, n = zip(*out, strict=True)
                times = [len(x) for x in first]
                yield pa.record_batch([np.concatenate(first).view(np.int64), np.repeat(np.array(node, dtype=np.int64), times), np.repeat(np.array(n, dtype=np.int32), times)], names=["sig", "node", "n"])
        trim()

    return docs.select("text").mapInArrow(rows, "sig long, node long, n int")


def lists(prefix: DataFrame, percent: int) -> DataFrame:
    """sig, node, n, m of the rows in inverted lists of two nodes or more; m is the list's length."""

    def whole(x: pd.DataFrame) -> pd.DataFrame:
        sig, node, n = (x[c].to_numpy() for c in ("sig", "node", "n"))
        fresh = np.ones(len(sig), dtype=bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, n = sig[fresh], node[fresh], n[fresh]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        m = np.diff(np.append(start, len(sig)))
        many = np.repeat(m, m) > 1
        # A neighbour in size (rows are sorted by it) within reach, on either side.
        reach = np.zeros(len(sig), dtype=bool)
        close = (sig[1:] == sig[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
        reach[1:] |= close
        reach[:-1] |= close
        keep = many & reach
        return pd.DataFrame({"sig": sig[keep], "node": node[keep], "n": n[keep], "m": np.repeat(m, m)[keep].astype(np.int32)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:  # sorted by sig; the last list of what is held may go on in the next batch
            held.append(b)
            size += len(b)
            if size < 200_000 or b["sig"].iat[0] == b["sig"].iat[-1]:
                continue
            x = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(x["sig"].to_numpy(), x["sig"].iat[-1]))
            yield whole(x.iloc[:cut])
            held = [x.iloc[cut:]]
            size = len(held[0])
        if size:
            yield whole(pd.concat(held, ignore_index=True))
        held.clear()
        trim()

    return prefix.repartition("sig").sortWithinPartitions("sig", "n", "node").mapInPandas(rows, "sig long, node long, n int, m int")


def members(listed: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """leader, lo, hi, node: the groups, without those of one node, as pairs of blocks.

    A group of more than block_sets nodes or block_shingles shingles is dealt into blocks by a hash, and every block
    meets itself and every other (lo, hi); most groups are one block (0, 0).
    """
    central = listed.groupBy("node").agg(F.sum("m").alias("weight"))
    led = listed.join(central, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("top"))
    led = materialise(led.select("sig", F.col("top.node").alias("leader")), "leaders")
    pairs = materialise(listed.join(led, "sig").select("leader", "node", "n").distinct(), "pairs")
    size = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block_sets), F.ceil(F.col("total") / block_shingles)).cast("int")
    size = materialise(size.select("leader", blocks.alias("blocks")), "sizes")
    dealt = pairs.join(size, "leader").select("leader", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    dealt = dealt.select("leader", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("leader", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted batches, each whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in keys]
        if held and any(held[0].column(k)[0].as_py() != x[0] for k, x in zip(keys, columns, strict=True)):
            yield pa.concat_batches(held)
            held = []
        cuts = (np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1).tolist()
        for i, j in zip([0, *cuts], cuts, strict=False):
            whole = pa.concat_batches([*held, b.slice(i, j - i)]) if held else b.slice(i, j - i)
            held = []
            yield whole
        held.append(b.slice(cuts[-1] if cuts else 0))
    if held:
        yield pa.concat_batches(held)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bit h mod B for each hash, with B the power of two (1,024 at least) that is two to four times the set's size."""
    size = max(64 * _WORDS, 1 << (2 * len(s)).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def can_link(n: np.ndarray, maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members could reach the needed overlap with some other one, by size and bitmap.

    Each bit in which two bitmaps differ is a shingle that one set lacks. Sets that may link differ in size so little
    that their bitmaps are of one length or of double; the longer is folded. Three eighths of the words show of most
    pairs that they differ too much; the rest is read of the others.
    """
    out = np.zeros(len(n), dtype=bool)
    order = np.argsort(n, kind="stable")
    n = n[order]
    words = np.array([len(maps[i]) for i in order])
    high = np.searchsorted(n, n * 100 // percent, side="right")
    for w in np.unique(words):
        begin, end = np.searchsorted(words, w), np.searchsorted(words, w, side="right")
        stop = np.searchsorted(words, 2 * w, side="right")
        rows = [maps[i] for i in order[begin:end]] + [maps[i][:w] | maps[i][w:] for i in order[end:stop]]
        held = np.stack(rows)
        first = 3 * int(w) // 8
        some, rest = np.ascontiguousarray(held[:, :first].T), held[:, first:]
        for i in range(begin, end):
            stop_i = min(high[i], stop)
            if i + 1 >= stop_i:
                continue
            m = n[i + 1 : stop_i]
            spare = m + n[i] - 2 * least_overlap(m, n[i], percent)
            x, y = i - begin, slice(i + 1 - begin, stop_i - begin)
            differ = np.bitwise_count(some[:, y] ^ some[:, x : x + 1]).sum(axis=0, dtype=np.uint32)
            left = np.flatnonzero(differ <= spare)
            if not len(left):
                continue
            at = left + (i + 1 - begin)
            hit = at[differ[left] + np.bitwise_count(rest[at] ^ rest[x]).sum(axis=1, dtype=np.int64) <= spare[left]]
            if len(hit):
                out[order[i]] = True
                out[order[hit + begin]] = True
    return out


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, occurrences) of the values that at least `least` of the sorted lists have, by a heap of the lists' heads.

    A value with too few occurrences lets as many lists as could not reach the threshold alone jump, by binary search,
    to the next value that the others have.
    """
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapify(heap)
    at, found = [0] * len(lists), []
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heappop(heap)[1])
        if len(taken) >= least:
            found.append((top, len(taken)))
            for i in taken:
                at[i] += 1
                if at[i] < len(lists[i]):
                    heappush(heap, (lists[i][at[i]], i))
            continue
        while heap and len(taken) < least - 1:
            taken.append(heappop(heap)[1])
        if not heap:
            break
        goal = heap[0][0]
        for i in taken:
            at[i] = bisect_left(lists[i], goal, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))
    return found


def divide_skip(sets: list[np.ndarray], percent: int = 80, mu: float = 0.0085) -> list[tuple[int, int]]:
    """Links that join the components of the sets: T-occurrence queries with DivideSkip, sets in the order given.

    For a query of size n every partner of at least its size needs T = least_overlap(n, n); the L longest lists are set
    aside, partners with T - L occurrences in the short ones are probed in the long ones by binary search.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    token, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(place, kind="stable")
    owners, freq = owner[by], np.bincount(place, minlength=len(token))
    begin = np.concatenate([[0], np.cumsum(freq)])
    own = np.split(place, np.cumsum(size)[:-1])
    root, links = np.arange(len(sets)), []
    kin: list[np.ndarray] = [np.array([i]) for i in range(len(sets))]
    for x in range(len(sets)):
        if len(kin[root[x]]) == len(sets):
            break
        n = int(size[x])
        t = int(least_overlap(n, n, percent))
        mine = own[x][np.argsort(freq[own[x]], kind="stable")]
        longest = int(freq[mine[-1]])
        aside = min(t - 1, max(int(t / (mu * np.log2(max(longest, 2)) + 1)), 0))
        short, long_ = mine[: n - aside], np.sort(mine[n - aside :])
        merged = merge_skip([owners[begin[k] : begin[k + 1]].tolist() for k in short.tolist()], t - aside)
        for y, c in merged:
            m = int(size[y])
            # Each pair is asked from its smaller set, or the earlier of equal ones.
            if not (m > n or (m == n and y > x)) or percent * m > 100 * n or root[y] == root[x]:
                continue
            least = int(least_overlap(m, n, percent))
            if c + aside < least:
                continue
            at = np.searchsorted(own[y], long_)
            c += int((own[y][np.minimum(at, m - 1)] == long_).sum())
            if c >= least:
                links.append((x, y))
                a, b = sorted((root[x], root[y]), key=lambda r: -len(kin[r]))
                root[kin[b]] = a
                kin[a] = np.concatenate([kin[a], kin[b]])
    return links


def ngram_join(docs: DataFrame, percent: int = 80, tracked: int = 16_384, frequent: int = 48, block_sets: int = 512, block_shingles: int = 4_000_000, broadcast_ids: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    tracked bounds the frequent-shingle summary and its broadcast; frequent is the count that makes one frequent (both
    only set the order of shingles); block_sets and block_shingles bound what one task searches at a time;
    up to broadcast_ids nodes (16 bytes each) are broadcast to find their texts, more are joined by a shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialise(describe(docs, tracked), "nodes")
    nodes = seen.where("NOT summary").drop("bits")
    top = seen.where("summary").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent).orderBy(F.desc("n"), "node").limit(tracked).collect()
    last = np.sort(np.array([r["node"] for r in top], dtype=np.int64).view(np.uint64))
    listed = materialise(lists(prefixes(docs, last, percent), percent), "lists")
    grouped = materialise(members(listed, block_sets, block_shingles), "groups")
    maps = seen.where("bits IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    task, large = ["leader", "lo", "hi"], 128  # from so many rows on, memory goes back to the system after a group

    def in_groups(df: DataFrame) -> DataFrame:
        return df.repartition(*task).sortWithinPartitions(*task)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = [], 0
        for x in groups(batches, task):
            bits = [np.frombuffer(m, dtype=np.uint64) for m in x.column("bits").to_numpy(zero_copy_only=False)]
            near = can_link(x.column("n").to_numpy(), bits, percent)
            if near.any():
                out.append(x.select([*task, "node"]).filter(pa.array(near)))
                rows += out[-1].num_rows
            if len(bits) >= large:
                del x, bits
                trim()
            if rows >= 1000:
                yield pa.concat_batches(out)
                out, rows = [], 0
        if out:
            yield pa.concat_batches(out)
        trim()

    close = materialise(in_groups(grouped.join(maps, "node")).mapInArrow(prune, "leader long, lo int, hi int, node long"), "close")
    # One text of each node that is left, found by doc_id; the ids are broadcast while they are few.
    first = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(close.select("node").distinct(), "node", "left_semi")
    first = materialise(first, "firsts")
    side = F.broadcast(first) if first.count() <= broadcast_ids else first.hint("merge")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Rows of one doc_id may have other texts.
            ok = [(w, s.tobytes()) for w, s in zip(b.column("node").to_pylist(), shingle_sets(b.column("text")), strict=True) if node_of(s) == w]
            yield pa.record_batch([pa.array([w for w, _ in ok], pa.int64()), pa.array([s for _, s in ok], pa.binary())], names=["node", "held"])
        trim()

    held = docs.join(side, "doc_id").select("node", "text").mapInArrow(sets, "node long, held binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for x in groups(batches, task):
            node, at = np.unique(x.column("node").to_numpy(), return_index=True)
            first = np.argsort(node != x.column("leader")[0].as_py(), kind="stable")
            node, sets = node[first], x.column("held").to_numpy(zero_copy_only=False)[at[first]]
            found = divide_skip([np.frombuffer(s, dtype=np.uint64) for s in sets], percent)
            a += [node[i] for i, _ in found]
            b += [node[j] for _, j in found]
            if len(node) >= large:
                del x, sets
                trim()
            if len(a) >= 1000:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim()

    links = in_groups(close.join(held, "node")).mapInArrow(search, "a long, b long")
    roots = materialise(components(links), "roots")
    # By node, then by document: both joins have a small table on one side that is written first, so that Spark can
    # split the rows of a frequent node or root among tasks.
    least = materialise(nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")), "least")
    rooted = materialise(least.join(roots, "node").select("node", "root", "least"), "rooted")
    by_root = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    linked = rooted.join(by_root, "root").select("node", "component_id")
    alone = least.join(roots.select("node"), "node", "left_anti").select("node", F.col("least").alias("component_id"))
    by_node = materialise(linked.unionByName(alone), "by-node")
    out = nodes.join(by_node.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
