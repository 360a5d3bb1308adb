"""Suffix-array dedup: column-wise construction of a collection's Burrows-Wheeler transform.

Every 50-byte string of every text is judged. Texts are cut into short overlapping strings: a run of consecutive 50-byte
windows that have the same minimizer (the least hash of a 16-byte substring). Equal windows have equal minimizers, so
sending strings to shards by minimizer brings equal windows together, and each shard is a collection of strings of at
most 84 bytes. It takes two rounds, so that the bytes of what occurs once never move: the first sends minimizers and two
hashes of what lies beside them, and tells each document which of its strings may have a window that another document has
too; the second sends those strings.

A window has 17 bytes before its minimizer or 18 after it, so strings with an equal window have the minimizer and the
17 before it or the 18 after it in common. The hashes are of those; a string without a window that has them sends none. This
holds where all windows of both strings have the first occurrence of their minimizer at one place; where some string with a
minimizer is not like that, all strings with that minimizer go on if two documents have it.

A shard builds the transform of its distinct strings column by column: each round inserts one symbol of every string. A
string that alone has its minimizer, once equal strings are one, has no window in common with another and needs no transform.
The places of the new symbols follow from the transform so far (the stable order of its symbols, an LF step), and one
sequential sweep merges them into the column, and into a second one of the bytes (50 at most) that each suffix shares
with the one before it. Following the finished transform gives every suffix's place; suffixes that share 50 bytes with
their neighbour form classes; a window goes if its class also starts in a smaller document.

The columns are arrays that one sweep a round reads and rewrites in order; with shards of bounded size they are held in
memory, and with `external` they are files in the task's temporary folder, removed at the end of the task.

Defined cases: null or empty text has no bytes and nothing removed; a row with a null doc_id neither removes nor loses
bytes; rows with equal doc_id do not remove each other's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorant.llm.common import documents, id_in, id_out, materialise, release, small_batches

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1  # 16-byte substrings in a window, and the most windows in a string
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BEFORE, _AFTER = REACH // 2, REACH // 2 + 1  # bytes beside a minimizer, one or the other of which each window has
_BLOCK = 3_000_000
_CHUNK = 1 << 15
_COLLECTION = 300_000
_WIDE = 64
_LOG = np.frexp(np.maximum(np.arange(2 * _WIDE + 1), 1).astype(float))[1].astype(np.int64) - 1


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _hashes(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the 16-byte substring at each place, and the least of each window's; in pieces that fit the processor's cache."""
    eight = np.ndarray(shape=(n + LENGTH,), dtype="<u8", buffer=flat, strides=(1,))
    h, least = np.empty(n + LENGTH - 8, dtype=np.uint64), np.empty(n + GRAM - 8, dtype=np.uint64)
    for i in range(0, len(least), _CHUNK):
        z = min(i + _CHUNK, len(least))
        x = eight[i : z + REACH - 1] * _P1
        x ^= eight[i + 8 : z + REACH + 7]
        x *= _P2
        x ^= x >> np.uint64(29)
        x *= _P1
        h[i : z + REACH - 1] = x
        least[i:z] = _sliding_least(x, REACH)
    return h, least


def strings(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of some texts: text index, start, windows, minimizer; and the texts' bytes, to which starts add their base.

    Returned as (text, base + start, windows, minimizer, bytes, hashes of the substrings).
    """
    size = np.array([len(r) for r in raws], dtype=np.int64)
    flat = np.frombuffer(b"".join(raws) + bytes(LENGTH + 8), dtype=np.uint8)
    n = int(size.sum())
    h, least = _hashes(flat, n)
    base = np.cumsum(size) - size
    stop = base + size - LENGTH + 1
    new = np.zeros(n, dtype=bool)
    new[1:] = least[1:n] != least[: max(n - 1, 0)]
    new[base[size > 0]] = True
    begin = np.flatnonzero(new)
    text = np.searchsorted(base, begin, side="right") - 1
    inside = begin < stop[text]
    begin, text = begin[inside], text[inside]
    windows = np.minimum(np.append(begin[1:], n)[: len(begin)], stop[text]) - begin
    if (windows > REACH).any():
        parts = -(-windows // REACH)
        at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, text, windows = np.repeat(begin, parts) + at * REACH, np.repeat(text, parts), np.minimum(np.repeat(windows, parts) - at * REACH, REACH)
    return text, begin, windows, least[begin], flat, h


def sides(at: np.ndarray, windows: np.ndarray, key: np.ndarray, flat: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string 16-bit hashes, from 1 on, of the 17 bytes before its minimizer and the 18 after it: 0 where no window of
    the string has them, both 0 if not all windows have the minimizer's first occurrence at one place."""
    place = np.empty(len(at), dtype=np.int64)  # of the first occurrence in the first window
    of = np.lib.stride_tricks.sliding_window_view(h, REACH)
    for i in range(0, len(at), _CHUNK // 16):
        x = slice(i, i + _CHUNK // 16)
        place[x] = (of[at[x]] == key[x, None]).argmax(axis=1)
    eight = np.ndarray(shape=(len(flat) - 7,), dtype="<u8", buffer=flat, strides=(1,))
    one = place >= windows - 1
    out = []
    for has, first, n in ((place >= _BEFORE, -_BEFORE, _BEFORE), (place - windows + 1 < _BEFORE, GRAM, _AFTER)):
        x = np.flatnonzero(one & has)
        i = at[x] + place[x] + first
        with np.errstate(over="ignore"):
            v = ((eight[i] * _P1 ^ eight[i + 8]) * _P2 ^ eight[i + n - 8]) * _P1
            v = (v ^ v >> np.uint64(32)) * _P2
        side = np.zeros(len(at), dtype=np.uint16)
        side[x] = (v >> np.uint64(40)) % np.uint64(0xFFFF) + np.uint64(1)
        out.append(side)
    return out[0], out[1]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(b: bytes, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(-1, n).T).view(kind).ravel()


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


_KINDS = {"key": "<u4", "doc": "<i8", "sub": "<i4", "start": "<u4", "windows": "<u2", "before": "<u2", "after": "<u2"}
_SENT, _ASKED = ("key", "doc", "sub", "start", "windows"), ("key", "doc", "sub", "start", "before", "after")


def _pack(columns: dict[str, np.ndarray], content: bytes = b"") -> bytes:
    """Columns (key sorted, as differences) by byte planes, then content, compressed."""
    out = [np.array([len(columns["key"])], dtype="<u4").tobytes()]
    for name, x in columns.items():
        out.append(_planes((np.diff(x, prepend=np.uint32(0)) if name == "key" else x).astype(_KINDS[name])))
    return zstandard.compress(b"".join([*out, content]), 1)


def _unpack(payload: bytes, names: tuple[str, ...]) -> tuple[dict[str, np.ndarray], bytes]:
    raw = zstandard.decompress(payload)
    n, at, out = int(np.frombuffer(raw[:4], "<u4")[0]), 4, {}
    for name in names:
        width = np.dtype(_KINDS[name]).itemsize * n
        out[name] = _from_planes(raw[at : at + width], _KINDS[name], n)
        at += width
    out["key"] = np.cumsum(out["key"], dtype=np.uint32)
    return out, raw[at:]


def _parts(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], list]]:
    """Texts of 50 bytes or more in blocks: doc_id, sub, bytes, chosen (None where there is no such column)."""
    held: list[tuple] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray, list[bytes], list]:
        return np.array([x[0] for x in held], dtype=np.int64), np.array([x[1] for x in held], dtype=np.int64), [x[2] for x in held], [x[3] for x in held]

    for b in batches:
        chosen = b["chosen"] if "chosen" in b else [None] * len(b)
        for d, s, t, c in zip(b["doc_id"].tolist(), b["sub"].tolist(), b["text"], chosen, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw) >= LENGTH:
                held.append((d, s, raw, c))
                size += len(raw)
            if size >= _BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _by_shard(key: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by shard and key; in it, the shards, the keys within a shard, and where shards begin and end."""
    shard = ((key >> np.uint64(32)) % np.uint64(n_shards)).astype(np.int64)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    order = np.lexsort((low, shard))
    shard, low = shard[order], low[order]
    return order, shard, low, np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))


def minimizers(docs: DataFrame, n_shards: int) -> DataFrame:
    """shard, payload: minimizer, document, ordinal and sides of every string."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, sub, raws, _ in _blocks(batches):
            text, at, windows, key, flat, h = strings(raws)
            before, after = sides(at, windows, key, flat, h)
            del h
            ordinal = np.arange(len(text)) - np.searchsorted(text, text)
            order, shard, low, cuts = _by_shard(key, n_shards)
            columns = {"key": low, "doc": doc[text[order]], "sub": sub[text[order]], "start": ordinal[order], "before": before[order], "after": after[order]}
            out = [(int(shard[i]), _pack({k: v[i:j] for k, v in columns.items()})) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["shard", "payload"])

    return docs.mapInPandas(rows, "shard int, payload binary")


def _of_two(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries are in a group with two documents; entries of a group follow each other."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    if not len(begin):
        return np.zeros(0, dtype=bool)
    return np.repeat(np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin), np.diff(np.append(begin, len(group))))


def shared_ordinals(payloads: list[bytes]) -> pd.DataFrame:
    """doc_id, sub, ordinal of the strings of a shard that may have a window of another document: by minimizer and a side."""
    x = _parts([_unpack(p, _ASKED)[0] for p in payloads])
    order = np.argsort(x["key"], kind="stable")
    order = order[_of_two(x["key"][order], x["doc"][order])]
    key = x["key"][order].astype(np.int64)
    group = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
    several = np.zeros(len(key), dtype=bool)  # by group: some string has no one place of its minimizer
    several[group[(x["before"][order] | x["after"][order]) == 0]] = True
    chosen = several[group]
    for side in ("before", "after"):
        of = x[side][order]
        some = np.flatnonzero(of)
        alike = key[some] << 16 | of[some]
        by = np.argsort(alike)
        some = some[by]
        chosen[some[_of_two(alike[by], x["doc"][order[some]])]] = True
    chosen = np.sort(order[chosen])
    return pd.DataFrame({"doc_id": x["doc"][chosen], "sub": x["sub"][chosen], "ordinal": x["start"][chosen].astype(np.int32)})


def contents(docs: DataFrame, n_shards: int) -> DataFrame:
    """shard, payload: the chosen strings of docs (doc_id, sub, text, chosen: arrays of ordinals), with their bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, sub, raws, chosen in _blocks(batches):
            text, at, windows, key, flat, _ = strings(raws)
            first = np.searchsorted(text, np.arange(len(raws)))
            take = np.concatenate([first[i] + np.sort(np.asarray(c, dtype=np.int64)) for i, c in enumerate(chosen)]).astype(np.int64)
            text, at, windows = text[take], at[take], windows[take]
            order, shard, low, cuts = _by_shard(key[take], n_shards)
            text, at, windows = text[order], at[order], windows[order]
            base = np.cumsum([0] + [len(r) for r in raws])
            columns = {"key": low, "doc": doc[text], "sub": sub[text], "start": at - base[text], "windows": windows}
            out = [
                (int(shard[i]), _pack({k: v[i:j] for k, v in columns.items()}, _gather(flat, at[i:j], windows[i:j] + LENGTH - 1).tobytes()))
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
            ]
            yield pd.DataFrame(out, columns=["shard", "payload"])

    return docs.mapInPandas(rows, "shard int, payload binary")


def _order(symbols: np.ndarray) -> np.ndarray:
    """The stable order of byte symbols, by counting."""
    return pc.array_sort_indices(pa.array(np.asarray(symbols))).to_numpy().view(np.int64)


def _places(by: np.ndarray, first: np.ndarray, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where `by` has each place; by: the stable order of symbols, first[x]: where symbol x begins in it; symbol and place: sorted by both."""
    out = np.empty(len(place), dtype=np.int64)
    cuts = np.append(np.flatnonzero(np.diff(symbol, prepend=-1)), len(symbol)).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        a, z = first[symbol[i]], first[symbol[i] + 1]
        out[i:j] = np.searchsorted(by[a:z], place[i:j]) + a
    return out


def _least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of values[left..right], ends included, for each pair: minima over powers of two, up to the widest asked;
    from _WIDE values on, over blocks of as many."""
    size = right - left + 1
    wide = size >= 2 * _WIDE
    k = np.minimum(_LOG[np.minimum(size, 2 * _WIDE)], _LOG[_WIDE])
    n, top = len(values), int(k.max(initial=0))
    table = np.empty((top + 1, n), dtype=values.dtype)
    table[0] = values
    for j in range(top):
        width = n - (2 << j) + 1
        np.minimum(table[j, :width], table[j, 1 << j : (1 << j) + width], out=table[j + 1, :width])
    flat = table.ravel()
    out = np.minimum(flat[k * n + left], flat[k * n + right - (1 << k) + 1])
    if wide.any():  # the ends are done; the blocks between them
        blocks = np.ascontiguousarray(table[top, : n // _WIDE * _WIDE : _WIDE])
        a, z = -(-left[wide] // _WIDE), (right[wide] + 1) // _WIDE - 1
        out[wide] = np.minimum(out[wide], _least_between(blocks, a, z))
    return out


def collection_order(flat: np.ndarray, start: np.ndarray, size: np.ndarray, external: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted suffixes of a collection of strings, as (string, suffix length, prefix shared with the one before, at
    most LENGTH), by the transform built column by column.

    Round j inserts, for each string of at least j symbols, the symbol before its suffix of length j (255, never in UTF-8,
    where there is none). The suffixes with an entry before them, in stable order of that entry, are the new order
    after the empty suffixes, so an entry's rank among equal symbols is the place of the suffix it begins. A suffix and
    the one before it that begin with one symbol share one more than the least that their tails, and those between the
    tails, share with their predecessors; so each round settles the prefixes of what it inserts and of what follows that.
    external: a folder in which the column and the prefixes are files, written in order each round.
    """
    m = len(start)
    end = start + size

    def column(name: str, n: int) -> np.ndarray:
        return np.empty(n, dtype=np.uint8) if external is None else np.memmap(f"{external}/{name}", dtype=np.uint8, mode="w+", shape=(n,))

    mark, shared = flat[end - 1].copy(), np.zeros(m, dtype=np.uint8)
    held = np.bincount(mark, minlength=256)  # entries by symbol
    who, fresh = np.arange(m), np.arange(m)  # strings by the place of the newest entry, and those places
    for j in range(1, int(size.max(initial=0)) + 1):
        last = mark[fresh]
        going = np.flatnonzero(last != 255)
        going = going[_order(last[going])]
        by = _order(mark)
        first = np.append(0, np.cumsum(held))
        # Places among the suffixes that are not empty, and strings.
        at = _places(by, first, last[going].astype(np.int64), fresh[going])
        who = who[going]
        fresh = at + m
        more = size[who] > j
        symbol = np.where(more, flat[np.where(more, end[who] - j - 1, 0)], 255).astype(np.uint8)
        held = held + np.bincount(symbol, minlength=256)
        n = len(mark) + len(at)
        c, prefix = column(f"column{j % 2}", n), column(f"prefix{j % 2}", n)
        old = np.ones(n, dtype=bool)
        old[fresh] = False
        c[old], prefix[old] = mark, shared
        c[fresh] = symbol
        after = at + 1  # what follows an insertion, unless inserted too
        after = after[np.append(at[1:] != after[:-1], after[-1] < n - m)] if len(at) else after
        ask = np.concatenate([at, after])
        if len(at) and at[0] == 0:
            prefix[m], ask = 0, ask[1:]
        before, own = by[ask - 1], by[ask]
        same = mark[before] == mark[own]
        value = np.zeros(len(ask), dtype=np.uint8)
        if same.any():
            value[same] = np.minimum(_least_between(shared, before[same] + 1, own[same]), LENGTH - 1) + 1
        prefix[m + ask] = value
        mark, shared = c, prefix
    # Follow the transform from the empty suffixes on: the place of each string's suffix of length 1, 2, ...
    step = np.empty(len(mark), dtype=np.int64)
    step[_order(mark)] = np.arange(m, len(mark) + m)
    string, depth = np.empty(len(mark), dtype=np.int32), np.zeros(len(mark), dtype=np.uint8)
    who, place = np.arange(m), np.arange(m)
    string[place] = who
    for j in range(1, int(size.max(initial=0)) + 1):
        going = size[who] >= j
        who, place = who[going], step[place[going]]
        string[place], depth[place] = who, j
    return string, depth, shared


def repeated(flat: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, external: str | None = None) -> np.ndarray:
    """For each window of each string, in order, the smallest document of the window's class; least: that of each string."""
    string, depth, shared = collection_order(flat, start, size, external)
    # Suffixes shorter than a window lie between classes, never within one: what shares LENGTH bytes has as many.
    begin = np.flatnonzero(shared < LENGTH)
    low = np.repeat(np.minimum.reduceat(np.where(depth >= LENGTH, least[string], np.iinfo(np.int64).max), begin), np.diff(np.append(begin, len(string)))) if len(string) else np.zeros(0, dtype=np.int64)
    whole = depth >= LENGTH
    string, offset, low = string[whole], (size[string[whole]] - depth[whole]).astype(np.int64), low[whole]
    windows = size - LENGTH + 1
    out = np.empty(int(windows.sum()), dtype=np.int64)
    out[(np.cumsum(windows) - windows)[string] + offset] = low
    return out


def shard_spans(payloads: list[bytes], external: bool = False) -> pd.DataFrame:
    """doc_id, sub, span (start << 32 | end) of the bytes to remove that a shard sees."""
    none = pd.DataFrame({"doc_id": np.zeros(0, np.int64), "sub": np.zeros(0, np.int32), "span": np.zeros(0, np.int64)})
    parts = [_unpack(p, _SENT) for p in payloads]
    x = _parts([c for c, _ in parts])
    content = b"".join(c for _, c in parts)
    del parts
    doc, sub, start, windows = x["doc"], x["sub"], x["start"], x["windows"].astype(np.int64)
    size = windows + LENGTH - 1
    at = np.cumsum(size) - size
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(content[a : a + n], len(known)) for a, n in zip(at.tolist(), size.tolist(), strict=True)), dtype=np.int64, count=len(at))
    flat = np.frombuffer(b"".join(known) + bytes(8), dtype=np.uint8)
    size_ = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    del known, content
    least = np.full(len(size_), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    key = np.zeros(len(size_), dtype=np.uint32)
    key[which] = x["key"]
    start_, windows_ = np.cumsum(size_) - size_, size_ - LENGTH + 1
    first = np.cumsum(windows_) - windows_
    low = np.empty(int(windows_.sum()), dtype=np.int64)
    # A string that alone has its minimizer shares windows with itself only.
    _, group, members = np.unique(key, return_inverse=True, return_counts=True)
    alone = members[group] == 1
    low[_gather(np.arange(len(low)), first[alone], windows_[alone])] = np.repeat(least[alone], windows_[alone])
    # Collections small enough for the processor's cache; strings with one minimizer are in the same.
    part = key % np.uint32(max(1, int(size_[~alone].sum()) // _COLLECTION))
    order = np.flatnonzero(~alone)
    order = order[np.argsort(part[order], kind="stable")]
    with tempfile.TemporaryDirectory(dir=os.environ.get("TMPDIR")) if external else nullcontext() as folder:
        for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
            n = size_[mine]
            bytes_ = np.append(_gather(flat, start_[mine], n), np.zeros(8, dtype=np.uint8))
            low[_gather(np.arange(len(low)), first[mine], windows_[mine])] = repeated(bytes_, np.cumsum(n) - n, n, least[mine], folder)
    # Each occurrence's windows against its own document.
    row = np.repeat(np.arange(len(at)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    gone = low[first[which][row] + inside] < doc[row]
    row, inside = row[gone], inside[gone]
    if not len(row):
        return none
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(row)) - 1
    who = row[i]
    begin, end = start[who].astype(np.int64) + inside[i], start[who].astype(np.int64) + inside[j] + LENGTH
    return pd.DataFrame({"doc_id": doc[who], "sub": sub[who], "span": begin << 32 | end})


def _cut(raw: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    if not len(spans):
        return 0, 0, raw
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, spans & 0xFFFFFFFF, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, shard_bytes: int = 6_000_000, key_bytes: int = 48_000_000, external: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of docs (doc_id, text).

    shard_bytes, key_bytes: text bytes per shard of the two rounds, which bound a task's memory; external: columns as files.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("sub", F.lit(0))
    else:  # rows of one doc_id are told apart by a number
        docs = materialise(docs.withColumn("sub", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1), "numbered")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_keys, n_shards = max(1, -(-total // key_bytes)), max(1, -(-total // shard_bytes))

    def shared(x: pd.DataFrame) -> pd.DataFrame:
        return shared_ordinals(list(x["payload"]))

    def spans(x: pd.DataFrame) -> pd.DataFrame:
        return shard_spans(list(x["payload"]), external)

    usable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "sub", "text")
    chosen = materialise(minimizers(usable, n_keys).repartition(n_keys, "shard").groupBy("shard").applyInPandas(shared, "doc_id long, sub int, ordinal int"), "ordinals")
    release(docs.sparkSession)
    chosen = chosen.groupBy("doc_id", "sub").agg(F.collect_list("ordinal").alias("chosen"))
    found = materialise(contents(usable.join(chosen, ["doc_id", "sub"]), n_shards).repartition(n_shards, "shard").groupBy("shard").applyInPandas(spans, "doc_id long, sub int, span long"), "spans")
    release(docs.sparkSession)
    by_doc = found.groupBy("doc_id", "sub").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, s in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                gone, runs, left = _cut(raw, np.asarray(s, dtype=np.int64) if s is not None else np.zeros(0, dtype=np.int64))
                rows.append((d, len(raw), gone, runs, hashlib.sha256(left).hexdigest(), left))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    whole = docs.join(by_doc, ["doc_id", "sub"], "left").select(id_in("doc_id"), "text", "spans")
    return id_out(whole.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def brute(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each document by plain lookup; for tests."""
    first: dict[bytes, int] = {}
    raws = {d: (t or "").encode() for d, t in docs}
    for d in sorted(raws):
        for i in range(len(raws[d]) - LENGTH + 1):
            first.setdefault(raws[d][i : i + LENGTH], d)
    out = {}
    for d, raw in raws.items():
        spans = [i << 32 | i + LENGTH for i in range(len(raw) - LENGTH + 1) if first[raw[i : i + LENGTH]] < d]
        gone, runs, left = _cut(raw, np.array(spans, dtype=np.int64))
        out[d] = (len(raw), gone, runs, hashlib.sha256(left).hexdigest())
    return out


ORACLE = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM h)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, p FROM w JOIN f USING (g) WHERE first < doc_id),
b AS (SELECT doc_id, p, max(p + 50) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM b),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
t AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
l AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM (SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, len(h) // 2 AS a, NULL AS z FROM h)),
q AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS left_ FROM l JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(left_)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id) JOIN q USING (doc_id)
"""
