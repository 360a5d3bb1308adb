"""Each operator against a brute-force version on odd tables, empty tables and tables with clashing names."""

from __future__ import annotations

import gc
import hashlib
import os
import random
import re
import subprocess
import sys
import tracemalloc
import weakref
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonorant.llm import exact_dedup, kneser_ney, license_scan, ngram_join, packing, pii, quality_rules, source_mix, suffix_dedup, toxicity
from tests.llm.helpers import LABELS, odd, prose, table


@pytest.fixture(scope="module")
def rows():
    return odd(random.Random(5))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], LABELS)


def by_text(rows):
    return {r[1] or "" for r in rows}


OPERATORS = {
    "quality_rules": lambda d, m: quality_rules.quality_rules(d, m),
    "pii": lambda d, m: pii.find_pii(d),
    "ngram_join": lambda d, m: ngram_join.ngram_join(d),
    "source_mix": lambda d, m: source_mix.source_mix(d),
    "license_scan": lambda d, m: license_scan.license_scan(d),
    "packing": lambda d, m: packing.pack(d),
    "quality_classifier": lambda d, m: kneser_ney.quality_classifier(d, m),
    "exact_dedup": lambda d, m: exact_dedup.exact_dedup(d),
    "toxicity": lambda d, m: toxicity.toxicity(d, m),
    "suffix_dedup": lambda d, m: suffix_dedup.suffix_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_empty_and_clashing(spark, rows, labels, name):
    f = OPERATORS[name]
    assert f(table(spark, []), labels).count() == 0
    plain = f(table(spark, rows), labels)
    n = plain.count()
    assert n == len(rows) if name != "packing" else n >= len(rows)
    assert f(table(spark, rows, extra=True), labels).count() == n


def test_quality_counts(spark, rows, labels):
    texts = [r[1] for r in rows] + ["a b c a b c", "x x x x", "l1 w\nl1 w\n\n\nl1 w", "#$ | <a>"]
    got = quality_rules.quality_rules(table(spark, [(i, t) for i, t in enumerate(texts)]), labels).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines, seen, dups = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dups += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered))
        assert tuple(r[k] for k in quality_rules.BASE) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_forest_on_held_out_rows(spark):
    rng = random.Random(1)
    docs, marks = [], []
    for i in range(400):
        t = prose(rng, 150)
        bad = i % 8 == 0
        docs.append((i, " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in t.split()) if bad else t))
        if i < 240:
            marks.append((i, 0 if bad else 1, 0))
    got = quality_rules.quality_rules(table(spark, docs), spark.createDataFrame(marks, LABELS)).collect()
    late = [r for r in got if r["doc_id"] >= 240]
    assert np.mean([r["kept"] for r in late if r["doc_id"] % 8]) > 0.97 and not any(r["kept"] for r in late if r["doc_id"] % 8 == 0)


def test_quality_forest_learns_from_every_label(spark):
    """More labelled rows than the 6,000 that a sample once had: all set units, trees and threshold."""
    marks = spark.range(7000).selectExpr("id AS doc_id", "CAST(id % 9 > 0 AS int) AS quality")
    stats = spark.range(7000).selectExpr("id AS doc_id", "false AS failed", "array_repeat(CAST(id AS double), 9) AS rules")
    rows = quality_rules.learned_rows(stats, marks)
    assert rows.count() == 7000 and rows.where("half = 0").count() > 3300
    trees = quality_rules.tree_rows(rows, 7000, 128, 64, 1)
    assert [len(t) for t in trees] == [64] * 128 and len(np.unique(np.concatenate(trees), axis=0)) > 2900
    seen = []

    def held(cells, false_rejects, real=quality_rules.threshold):
        seen.append(int(cells["good"].sum() + cells["bad"].sum()))
        return real(cells, false_rejects)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "threshold", held)
        quality_rules.fit(stats, marks)
        quality_rules.fit(stats, marks, most_local=0)
    assert seen == [3500, rows.where("half = 1").count()]


def test_quality_threshold():
    cells = pd.DataFrame({"low": [0.5, 0.3, 0.4], "high": [0.55, 0.35, 0.4], "good": [0, 90, 10], "bad": [7, 0, 0]})
    assert quality_rules.threshold(cells, 0.002) == 0.45


PII = [
    "mail a.b+c@x-y.co.uk, x@y and p@q.r_s@t.u or a@b@c.de", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 00001.02.3.0255 9" + "9" * 30 + ".1.1.1", "4539 1488 0343 6467 4539148803436467-1 4539148803436468 1 2 3",
    "+1 (415) 555-0100 +1 +123456789012345678 +49-30-1234567-", "", None, "x" * 20_000 + "@a.b", "1." * 500, "é +1 (415) 555-0100 😀 a@b.cd", 'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"',
]


def test_pii_base_spans(spark):
    got = pii.find_pii(table(spark, list(enumerate(PII)))).collect()
    for r in got:
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == pii.brute_base(PII[r["doc_id"]])
        assert set(map(tuple, r["base"])) <= set(map(tuple, r["spans"]))


def test_pii_learns_secrets(spark):
    rng = random.Random(2)
    docs = []
    for i in range(60):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        docs.append((i, prose(rng, 30) + (f' token = "{secret}" ' if i % 2 else f" on {rng.randint(10**9, 10**10)} ") + prose(rng, 30)))
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(table(spark, docs)).collect()}
    assert all(got[i] == ([4] if i % 2 else []) for i in got)


def test_pii_names_and_addresses(spark):
    rng = random.Random(17)
    docs = []
    for i in range(80):
        more = ("as Mr John Q. Smith, ", "he lives at 12 Oak Street, Springfield and ", "the Old Mill Pond was ", "in Building Nine 47 and ")[i % 4]
        docs.append((i, prose(rng, 20).lower() + " " + more + prose(rng, 20).lower()))
    got = {r["doc_id"]: (docs[r["doc_id"]][1], r["spans"]) for r in pii.find_pii(table(spark, docs)).collect()}
    for i, (text, spans) in got.items():
        found = [(pii.KINDS[s["kind"]], text[s["start"] : s["end"]].strip()) for s in spans]
        if i % 4 == 0:
            assert any(k == "name" and "John Q. Smith" in x for k, x in found), (text, found)
        elif i % 4 == 1:
            assert any(k == "address" and x.startswith("12 Oak Street") for k, x in found), (text, found)
        else:
            assert found == []


def test_pii_candidates_with_a_late_digit(spark):
    from pyspark.sql import functions as F

    code = "Ab/" * 60 + "7f3c"
    texts = [f"the token {code} here", "x" * 300 + " only letters and 12345678", code + "-" * 40_000, "a" * 200_000]
    found = table(spark, list(enumerate(texts))).select("doc_id", pii.located(F.col("text"), pii.CANDIDATE).alias("s")).orderBy("doc_id").collect()
    assert [[s["m"] for s in r["s"]] for r in found] == [[code], [], [texts[2]], []]


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def components_of(ids, sets):
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * len(sets[i] | sets[j]):
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_finds_every_link(spark, seed):
    """Families of near copies at all distances around the limit, shared passages, equal and tiny texts."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 30), [None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = prose(rng, rng.randint(40, 200)).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w[: rng.choice([len(w), len(w), len(w) - 4])]))
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(30)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    sets = shingle_sets(texts)
    want = components_of(ids, [sets[i] for i in range(len(ids))])
    got = ngram_join.ngram_join(table(spark, list(zip(ids, texts, strict=True))), frequent=10).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(s) for d, s in zip(ids, sets, strict=True)}
    assert len(set(want.values())) < len(ids) - 10


def test_divide_skip_equals_all_pairs():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(25):
            s = set(base.tolist()) - set(rng.choice(base, rng.integers(0, 16)).tolist())
            sets.append(np.array(sorted(s | set(rng.choice(400, rng.integers(0, 8)).tolist())), dtype=np.uint64))
        found = ngram_join.divide_skip(sets)
        ids = list(range(len(sets)))
        want = components_of(ids, [set(s.tolist()) for s in sets])
        root = {i: i for i in ids}
        for a, b in found:
            o = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            assert 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o)
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
        assert root == want


def test_merge_skip_counts_occurrences():
    rng = random.Random(14)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 12))]
        c, least = Counter(x for y in lists for x in y), rng.randint(1, 12)
        assert ngram_join.merge_skip(lists, least) == sorted((k, n) for k, n in c.items() if n >= least)


def test_shingles_of_a_column_hash_each_word_once_a_piece(monkeypatch):
    """The sets of odd texts in any pieces and in a slice of a column, with few words hashed."""
    rng = random.Random(21)
    texts = ["", None, "  ", "a", " A b  c ", "a b c d e", "a b c d e f A B C D E", "é x \x1cy É\n"] + [prose(rng, 50) for _ in range(40)] + ["one two three four five six " * 200]
    calls, digest = [], ngram_join.xxhash.xxh64_intdigest
    monkeypatch.setattr(ngram_join.xxhash, "xxh64_intdigest", lambda w: calls.append(w) or digest(w))
    column = pa.array(["skipped", *texts])[1:]
    whole = list(ngram_join.shingle_sets(column))
    assert len(calls) == len(set(calls))
    assert [len(s) for s in whole] == [len(s) for s in shingle_sets(texts)]
    monkeypatch.setattr(ngram_join, "_PIECE", 100)
    for t, s, w in zip(texts, ngram_join.shingle_sets(column), whole, strict=True):
        assert s.tolist() == w.tolist() == sorted(set(w.tolist())) == ngram_join.shingles(t).tolist()


def test_groups_of_batches():
    keys = np.sort(np.random.default_rng(22).integers(0, 40, 300)).tolist()
    for size in (1, 3, 50, 300):
        batches = [pa.record_batch({"a": keys[i : i + size], "b": [7] * len(keys[i : i + size])}) for i in range(0, 300, size)]
        found = [x.column("a").to_pylist() for x in ngram_join.groups(iter([*batches, batches[0][:0]]), ["a", "b"])]
        assert sum(found, []) == keys and [set(x) for x in found] == [{k} for k in sorted(set(keys))]


@pytest.mark.parametrize("block", [8, 20])
def test_ngram_join_in_blocks(spark, block):
    """A family larger than a block, some of whose links lie between blocks only."""
    rng = random.Random(15)
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(59):  # chains of small changes: far members link through others
        w = texts[-1].split()
        w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [prose(rng, 90) for _ in range(10)]
    ids = list(range(len(texts)))
    got = ngram_join.ngram_join(table(spark, list(zip(ids, texts, strict=True))), block_sets=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_of(ids, shingle_sets(texts))


def test_bitmaps_lose_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for n in (20, 400, 520, 600, 3000):
        base = rng.integers(0, 1 << 62, n)
        for _ in range(12):
            keep = rng.random(n) > rng.choice([0.0, 0.05, 0.1, 0.3])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 62, rng.integers(0, n // 8))])).astype(np.uint64))
    got = ngram_join.can_link(np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], 80)
    linked = np.zeros(len(sets), dtype=bool)
    for i, a in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(a, sets[j]))
            if 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                linked[[i, j]] = True
    assert linked.any() and not (linked & ~got).any() and not got.all()


def test_source_mix(spark, rows):
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randint(1, 60)), "en", f"s{i % 3 if i % 2 else 0}") for i in range(1200)] + [(5000 + i, t) for i, (_, t, *_) in enumerate(rows)] + [(6000, "tiny", "en", None)]
    got = source_mix.source_mix(table(spark, docs)).collect()
    again = source_mix.source_mix(table(spark, docs)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        text = next(d[1] for d in docs if d[0] == r["doc_id"])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in got)
    # Shares by weight, capped at twice the size, the excess reshared until none is above.
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, want, free = 1.5 * sum(size.values()), {}, set(size)
    while free:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else share
        free = free - over if over else set()
    assert target == pytest.approx(want)
    largest = max(r["size"] for r in got if r["doc_id"] < 5000)
    assert all(abs(taken[s] - target[s]) <= largest for s in ("s0", "s1", "s2") if s != "s")


def test_source_mix_in_other_partitions(spark):
    rng = random.Random(16)
    docs = [(None if i % 9 == 0 else i // 2, prose(rng, rng.randint(0, 40)), "en", f"s{i % 5}") for i in range(400)]
    docs += docs[:30]
    runs = []
    for n in (1, 7, 64):
        got = source_mix.source_mix(table(spark, docs).repartition(n)).collect()
        runs.append(Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 300


def test_pivots_keep_expectations(spark):
    docs = table(spark, [(i, "w " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(200)])
    runs = [{r["doc_id"]: r["copies"] for r in source_mix.source_mix(docs, seed=s, block=16, share=0.9).collect()} for s in range(6)]
    mean = np.mean([[run[i] for i in range(200)] for run in runs])
    assert abs(mean - 0.9) < 0.05 and len({tuple(sorted(r.items())) for r in runs}) == 6


def test_license_base_places(spark, rows):
    texts = [r[1] for r in rows] + [
        "Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0 cc-by-nc", "Under The MIT license under the mit license", "cc by ncx", "xunder the mit license", "the mit", "Lizenz cc BY Nc é cc by nc",
        "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(table(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_scan.brute_base(t)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[len(texts) - 1]["labels"] == "gpl-3"


def test_license_whole_texts(spark):
    every = [(i, text.upper().replace(" ", ",\n", 3)) for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r["doc_id"]: r for r in license_scan.license_scan(table(spark, every)).collect()}
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert any(s["label"] == label and (s["start"], s["end"]) == (0, len(text.split())) for s in got[i]["spans"]), label


def test_license_templates_need_no_python(spark):
    plan = license_scan.template_grams(spark)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_license_with_edits(spark):
    t = license_scan.TEMPLATES[1][1].split()
    edited = " ".join(["intro"] * 5 + t[:8] + ["very"] + t[8:20] + t[21:])
    r = license_scan.license_scan(table(spark, [(1, edited), (2, " ".join(t[:6]))])).orderBy("doc_id").collect()
    assert r[0]["labels"] == "mit" and 0.6 <= r[0]["score"] < 1 and r[1]["labels"] == ""


def test_license_every_place(spark):
    passage = license_scan.TEMPLATES[1][1]
    n = len(passage.split())
    rng = random.Random(4)
    many = " ".join(f"{prose(rng, 20)} licensed under cc by sa 4 0" for _ in range(300))
    texts = [
        f"{passage} some words between {passage}",
        f"{passage} {passage}",
        "Code licensed under the GNU General Public License version 3 and, in part, other code released under the GNU General Public License version 2.",
        many,
        None,
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(table(spark, list(enumerate(texts)))).collect()}
    assert [tuple(s) for s in got[0]["spans"]] == [(0, n, "mit"), (n + 3, 2 * n + 3, "mit")] and got[0]["labels"] == "mit"
    assert [tuple(s) for s in got[1]["spans"]] == [(0, n, "mit"), (n, 2 * n, "mit")]
    assert got[2]["labels"] == "gpl-2,gpl-3" and [s["label"] for s in got[2]["spans"]] == ["gpl-3", "gpl-2"]
    assert len(got[3]["spans"]) == 300 and {s["label"] for s in got[3]["spans"]} == {"cc-by-sa"} and got[3]["score"] == 1.0
    assert (got[4]["n_words"], got[4]["labels"], got[4]["spans"], got[4]["score"]) == (0, "", [], 0.0)


def test_packing_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    texts = [r[1] for r in rows] + [prose(rng, rng.randint(1, 900)) for _ in range(150)] + ["a\x1cb\xa0c d", "J̌ É KELVIN K", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "it's we'RE"]
    got = packing.pack(table(spark, list(enumerate(texts))), local=40).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k, s, len(ids[s : s + 4096]), crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(bins) <= 1.15 * sum(r["length"] for r in got) / 4096 + 2


def test_packing_what_has_no_partner(spark):
    """200,000 pieces of which no two fit together: no task beyond the first level gets more than its share."""
    from pyspark.sql import functions as F

    n = 200_000
    cut = spark.range(0, n, 1, 20).select(F.col("id").cast("string").alias("doc_id"), (2200 + F.col("id") % 1600).cast("long").alias("length"))
    got = packing.place(cut, 4096, local=5000, fan_in=4, handed=64)
    assert got.count() == n == got.select("sequence_id").distinct().count() and got.where("offset <> 0").count() == 0
    fill = np.arange(2200, 3800)
    assert packing.handed_on(fill, 4096, 2200, 64).sum() == 0 and packing.handed_on(fill, 4096, 1, 64).sum() == 64
    assert packing.handed_on(np.append(fill, [100, 2048]), 4096, 100, 64)[-2:].all()


def test_packing_over_levels(spark):
    """Small and large pieces in many tasks end within a hundredth of the bound, each sequence gapless."""
    from pyspark.sql import functions as F

    cut = spark.range(0, 60_000, 1, 24).select(F.col("id").cast("string").alias("doc_id"), (1 + F.pmod(F.xxhash64("id"), F.lit(3000))).cast("long").alias("length"))
    got = packing.place(cut, 4096, local=500, fan_in=4)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("begin"), F.countDistinct("offset").alias("k"), F.count("*").alias("m")).toPandas()
    assert (bins["n"] == bins["end"]).all() and (bins["begin"] == 0).all() and (bins["k"] == bins["m"]).all() and bins["n"].max() <= 4096
    assert len(bins) <= 1.01 * bins["n"].sum() / 4096 + 1


def test_best_fit():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 101, 500)
    where, offset, fill = packing.best_fit(x, 100)
    assert (np.bincount(where, weights=x) == fill).all() and fill.max() <= 100 and len(fill) <= 1.1 * x.sum() / 100
    assert all(sorted(offset[where == b])[0] == 0 for b in range(len(fill)))


def test_kneser_ney_is_a_distribution():
    counts = np.zeros(kneser_ney.N_CLASSES**kneser_ney.ORDER, dtype=np.int64)
    rng = random.Random(7)
    for _ in range(30):
        np.add.at(counts, kneser_ney.ngrams(prose(rng, 60)), 1)
    p = np.exp(kneser_ney.probabilities(counts)).reshape(-1, kneser_ney.N_CLASSES)
    seen = counts.reshape(-1, kneser_ney.N_CLASSES).sum(axis=1) > 0
    assert np.allclose(p.sum(axis=1), 1.0, atol=1e-4) and (p[seen][:, 1:] > 0).all() and (p[:, 0] < 1e-11).all()
    assert kneser_ney.reduced("a a a b\nb c") == ("a b c", 3, 6) and kneser_ney.reduced(None) == ("", 0, 0)


def test_classes_of_other_scripts():
    def of(text):
        return kneser_ney.classes_of(np.array([ord(c) for c in text], dtype=np.uint32)).tolist()

    for letters in ("абвгдежзиклмнопрстуфхцчшщъыь", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزس", "日本語文章漢字"):
        assert len(set(of(letters))) >= 0.6 * len(letters) and 47 not in of(letters)
    assert set(of("“”„–—…😀\ufe0f\U0010ffff")) == {47} and of("Ж٣\u3000") == [30, 3, 1]
    assert of("aZ é\n") == [4, 30, 1, 43 + 0xE9 % 4, 2]
    assert not np.array_equal(kneser_ney.ngrams("слова речи"), kneser_ney.ngrams("ъъъъъ ъъъъ"))


def test_quality_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    docs, marks = [], []
    for i in range(300):
        t = prose(rng, 120)
        kind = i % 10
        docs.append((i, " ".join(f"{w} |" for w in t.split()) if kind == 0 else t.upper().replace(" ", "!! ") if kind == 1 else " ".join(w + " " + w for w in t.split()) if kind == 2 else t, "xy"[i % 2]))
        if i < 200:
            marks.append((i, int(kind > 2), 0))
    got = kneser_ney.quality_classifier(table(spark, docs), spark.createDataFrame(marks, LABELS)).collect()
    late = [r for r in got if r["doc_id"] >= 200]
    assert not any(r["kept"] for r in late if r["doc_id"] % 10 < 3) and all(r["kept"] for r in late if r["doc_id"] % 10 > 2)


def test_word_trigrams_against_plain_counts(spark):
    rng = random.Random(9)
    names = sorted(set(prose(rng, 60).split()))
    texts = [" ".join(rng.choice(names[: 5 + i % 40]) for _ in range(1 + i * 7 % 90)) for i in range(60)] + ["", "new words here only", names[0], f"{names[1]} new {names[1]} {names[2]}"]
    texts.append(texts[50])
    docs = spark.createDataFrame([(i, i < 45, t) for i, t in enumerate(texts)], "key long, trained boolean, text string")
    words = [[w for w, before in zip(t.split(), ["", *t.split()]) if w != before] for t in texts]
    code = np.concatenate([kneser_ney.spelled([w])[0] for x in words[:45] for w in x])
    spelling = kneser_ney.probabilities(np.bincount(code, minlength=kneser_ney.N_CLASSES**kneser_ney.ORDER))

    first = Counter(x[0] for x in words[:45])
    triples = Counter(g for x in words[:45] for g in zip(["", *x], x, x[1:]))
    pairs = Counter((v, w) for _, v, w in triples)
    ends = Counter(w for _, w in pairs)

    def level(counts):
        d = kneser_ney.discounts(kneser_ney.tally(np.array(list(counts.values()))))
        groups = defaultdict(list)
        for k, c in counts.items():
            groups[k[:-1] if isinstance(k, tuple) else ()].append(c)
        of = {k: (sum(c), sum(d[min(x, 3)] for x in c)) for k, c in groups.items()}

        def p(key, low):
            total, spare = of.get(key[:-1] if isinstance(key, tuple) else (), (0, 0))
            return (counts[key] - d[min(counts[key], 3)] + spare * low) / total if total else low

        return p

    p0, p1, p2, p3 = level(first), level(ends), level(pairs), level(triples)
    want = {}
    for i, x in enumerate(words):
        low = {w: p1(w, np.exp(spelling[kneser_ney.spelled([w])[0]].sum(dtype=float))) for w in x}
        want[i] = -sum(np.log(p3((u, v, w), p2((v, w), low[w]))) for u, v, w in zip(["", *x], x, x[1:])) - (np.log(p0(x[0], low[x[0]])) if x else 0)
    repeats = [len(t.split()) - len(x) for t, x in zip(texts, words)]
    for shard_words, passes in ((10**6, 1), (150, 3)):
        model = kneser_ney.train(docs.where("trained"), sum(map(len, words)), shard_words)
        assert (model.pairs is not None) == (shard_words == 150)
        cost = model.lowest.value().rest[2]
        got = {r["key"]: r["loss"] - repeats[r["key"]] * cost for r in kneser_ney.judged(docs, model, passes).collect()}
        assert got.keys() == {i for i, x in enumerate(words) if x}
        assert all(got[i] == pytest.approx(want[i], rel=1e-4) for i in got)


def test_words_of_a_block_go_with_it():
    known = kneser_ney.Numbers()
    assert known.of("b a b b c")[0].tolist() == [0, 1, 0, 2] and list(known) == ["b", "a", "c"]
    gone = weakref.ref(known)
    gc.disable()  # collections of cycles come late in a worker that is used again and again
    try:
        del known
        assert gone() is None
    finally:
        gc.enable()


def shard_payloads(n_words: int, texts: int, size: int) -> list[bytes]:
    rng = np.random.default_rng(3)
    words = kneser_ney.Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.array([1]))
    held = [(i, i % 3 > 0, (rng.zipf(1.3, size) % (n_words - kneser_ney.FIRST)).astype(np.int32)) for i in range(texts)]
    number = np.arange(kneser_ney.FIRST, n_words, dtype=np.int32)
    return [p for i in range(0, texts, 50) for _, p in kneser_ney._block(held[i : i + 50], number, words, 0, 1)]


def test_shard_of_few_and_of_many_numbers():
    payloads, d = shard_payloads(5_000, 200, 300), np.array([0.0, 0.6, 0.9, 1.2])
    low = np.log(np.linspace(1e-6, 1e-3, 5_000)).astype(np.float32)
    few = kneser_ney.losses(payloads, {}, low, d, d)
    many = kneser_ney.losses(payloads, {}, np.append(low, np.zeros(1 << 21, np.float32)), d, d)
    assert few.keys() == many.keys() and len(few) == 4
    for b in few:
        for (r, x), (s, y) in zip(few[b], many[b], strict=True):
            assert r.tolist() == s.tolist() and x.tolist() == y.tolist() and (x > 0).all()


def test_memory_of_a_shard():
    payloads, d = shard_payloads(5_000, 800, 500), np.array([0.0, 0.6, 0.9, 1.2])
    low = np.log(np.linspace(1e-6, 1e-3, 5_000)).astype(np.float32)
    tracemalloc.start()
    try:
        kneser_ney.losses(payloads, {}, low, d, d)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak / 400_000 < 60  # bytes an n-gram


def test_memory_of_counting():
    rng = random.Random(4)
    texts = [prose(rng, 200) for _ in range(400)]
    list(kneser_ney._count(iter([pd.DataFrame({"text": texts[:1]})])))
    tracemalloc.start()
    try:
        got = pd.concat(kneser_ney._count(iter([pd.DataFrame({"text": texts})])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = Counter(c for t in texts for w, before in zip(t.split(), ["", *t.split()]) if w != before for c in kneser_ney.spelled([w])[0].tolist())
    assert {r.code: r.n for r in got[got["kind"] == 0].itertuples()} == want
    assert peak < 2 * 8 * kneser_ney.N_CLASSES**kneser_ney.ORDER  # the table of counts, and no other as large


def test_quality_classifier_tells_order_of_words(spark):
    rng = random.Random(10)
    names = sorted(set(prose(rng, 400).split()))
    after = {w: rng.sample(names, 2) for w in names}

    def chain(n):
        x = [rng.choice(names)]
        while len(x) < n:
            x.append(rng.choice([w for w in after[x[-1]] if w != x[-1]]))
        return x

    docs = [(i, " ".join(x if i % 3 else rng.sample(x, len(x)))) for i in range(300) for x in [chain(100)]]
    got = kneser_ney.quality_classifier(table(spark, docs), spark.createDataFrame([(i, 1, 0) for i in range(240) if i % 3], LABELS)).collect()
    late = [r for r in got if r["doc_id"] >= 240]
    assert not any(r["kept"] for r in late if r["doc_id"] % 3 == 0) and sum(r["kept"] for r in late if r["doc_id"] % 3) >= 38


@pytest.mark.parametrize("heavy", [2, 500])
def test_exact_dedup(spark, rows, heavy):
    rows = rows + [(20, "one\ttwo"), (21, "\none two"), (22, " one two")]
    got = exact_dedup.exact_dedup(table(spark, rows), heavy_rows=heavy).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    want = Counter()
    for t, ids in groups.items():
        least = min((d for d in ids if d is not None), default=None)
        for d in ids:
            want[d, least, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    docs, marks = [], []
    for i in range(600):
        w = prose(rng, 60).split()
        if i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "Loser!!"])
        docs.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 3 == 0)))
    got = toxicity.toxicity(table(spark, docs), spark.createDataFrame(marks, LABELS)).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


@pytest.mark.parametrize("external", [False, True])
def test_suffix_dedup(spark, rows, external):
    rng = random.Random(10)
    passage = prose(rng, 40)
    docs = [(i, prose(rng, 15) + passage[rng.randint(0, 60) : rng.randint(100, 200)] + prose(rng, 15)) for i in range(60)]
    docs += [(100 + i, t) for i, (_, t, *_) in enumerate(rows)] + [(200, "ab" * 200), (201, "ab" * 90), (202, "é" * 60), (203, "x" + "é" * 60), (204, "a" * 49), (205, "a" * 49)]
    rng.shuffle(docs)
    want = suffix_dedup.brute(docs)
    got = suffix_dedup.suffix_dedup(table(spark, docs), shard_bytes=3000, key_bytes=20_000, external=external).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got) and sum(r["n_removed"] for r in got) > 5000


def test_suffix_dedup_with_equal_ids(spark):
    rng = random.Random(11)
    a, b = prose(rng, 40), prose(rng, 40)
    got = suffix_dedup.suffix_dedup(table(spark, [(1, a), (1, a), (2, a), (2, b), (3, b), (None, a)])).collect()
    assert sorted(((r["doc_id"] or 0), r["n_removed"] > 0) for r in got) == [(0, False), (1, False), (1, False), (2, False), (2, True), (3, True)]


def test_suffix_dedup_sends_strings_with_a_shared_window(spark):
    """All strings that have a window of another document, also where minimizers repeat in them; not those that share a minimizer alone."""
    rng = random.Random(14)

    def sent(texts: list[str]) -> tuple[set, set, dict]:
        docs = table(spark, list(enumerate(texts))).select("doc_id", F.lit(0).alias("sub"), "text")
        x = suffix_dedup.shared_ordinals([bytes(r["payload"]) for r in suffix_dedup.minimizers(docs, 1).collect()])
        where: dict[bytes, set] = {}
        key: dict[tuple, int] = {}
        for d, t in enumerate(texts):
            _, start, windows, minimizer, *_ = suffix_dedup.strings([t.encode()])
            for i, (a, n, m) in enumerate(zip(start.tolist(), windows.tolist(), minimizer.tolist(), strict=True)):
                key[d, i] = m
                for j in range(n):
                    where.setdefault(t.encode()[a + j : a + j + 50], set()).add((d, i))
        need = set().union(*[s for s in where.values() if len({d for d, _ in s}) > 1])
        return need, set(zip(x["doc_id"].tolist(), x["ordinal"].tolist(), strict=True)), key

    phrase = prose(rng, 8)[:30]  # 15 substrings that may be minimizers, and 33 bytes in common only by chance
    need, got, key = sent([prose(rng, 20) + phrase + prose(rng, 20) for _ in range(40)])
    both = Counter(m for m, _ in {(m, d) for (d, _), m in key.items()})
    assert not need and 4 * len(got) < sum(both[m] > 1 for m in key.values())
    for letters in ("ab", "abcdefgh ", "a"):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(12)]
        parts += [x * (150 // len(x) + 1) for x in parts[:4]]
        need, got, _ = sent(["".join(rng.choice(parts) for _ in range(8)) for _ in range(6)])
        assert need and need <= got


def test_suffix_dedup_transforms_only_strings_that_share_a_minimizer(spark, monkeypatch):
    """Equal strings are one; if no other string has their minimizer, they need no transform."""
    rng = random.Random(15)
    a, b = prose(rng, 300), prose(rng, 300)
    docs = [(1, a), (2, a), (3, b[:700]), (4, b[650:]), (5, b)]
    copies = suffix_dedup.minimizers(table(spark, docs[:2]).select("doc_id", F.lit(0).alias("sub"), "text"), 1)
    chosen = suffix_dedup.shared_ordinals([bytes(r["payload"]) for r in copies.collect()]).groupby("doc_id")["ordinal"].apply(list).to_dict()
    rows = spark.createDataFrame([(d, 0, t, chosen[d]) for d, t in docs[:2]], "doc_id long, sub int, text string, chosen array<int>")
    payloads = [bytes(r["payload"]) for r in suffix_dedup.contents(rows, 1).collect()]

    def none(flat, start, size, *rest):
        raise AssertionError(f"{len(size)} strings")

    monkeypatch.setattr(suffix_dedup, "repeated", none)
    spans = suffix_dedup.shard_spans(payloads)
    monkeypatch.undo()
    assert set(spans["doc_id"]) == {2} and min(spans["span"]) >> 32 == 0 and max(spans["span"] & 0xFFFFFFFF) == len(a.encode())
    got = suffix_dedup.suffix_dedup(table(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == suffix_dedup.brute(docs)


def test_least_between_and_places():
    rng = np.random.default_rng(13)
    for n in (1, 63, 64, 200, 10_000):
        values = rng.integers(0, 50, n).astype(np.uint8)
        left = rng.integers(0, n, 300)
        right = np.minimum(left + rng.integers(0, rng.choice([2, 130, 9000], 300)), n - 1)
        assert suffix_dedup._least_between(values, left, right).tolist() == [values[a : b + 1].min() for a, b in zip(left, right, strict=True)]
        order = suffix_dedup._order(values)
        place = np.sort(rng.choice(n, -(-n // 3), replace=False))
        place = place[np.argsort(values[place], kind="stable")]
        first = np.append(0, np.cumsum(np.bincount(values, minlength=256)))
        assert (order[suffix_dedup._places(order, first, values[place].astype(np.int64), place)] == place).all()


def test_collection_order():
    rng = random.Random(12)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 84))) for _ in range(40)] + [b"a" * 60, b"a" * 84]
    flat, size = np.frombuffer(b"".join(strings) + bytes(8), np.uint8), np.array([len(s) for s in strings])
    s, d, shared = suffix_dedup.collection_order(flat, np.cumsum(size) - size, size)
    suffixes = [strings[i][len(strings[i]) - k :] for i, k in zip(s.tolist(), d.tolist(), strict=True)]
    assert suffixes == sorted(suffixes) and len(set(zip(s.tolist(), d.tolist(), strict=True))) == len(suffixes) == size.sum() + len(strings)
    for k, (x, y) in enumerate(zip(suffixes, suffixes[1:]), 1):
        both = next((n for n in range(min(len(x), len(y), 50)) if x[n] != y[n]), min(len(x), len(y), 50))
        assert shared[k] == both


KEPT = """
import re
import numpy as np
from sonorant.llm.common import trim
def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
x = [np.ones(5000, np.uint8) for _ in range(20_000)]
last = np.ones(5000, np.uint8)  # above the others
del x
full = mb()
trim()
print(full - mb())
"""


def test_workers_give_back_what_they_freed(monkeypatch):
    root = suffix_dedup.__file__.rsplit("/", 3)[0]
    out = subprocess.run([sys.executable, "-c", KEPT], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    assert float(out) > 80
    seen = []
    monkeypatch.setattr(kneser_ney, "trim", lambda: seen.append("trim"))
    for _ in kneser_ney._count(iter([pd.DataFrame({"text": ["a b c"]})])):
        seen.append("rows")
    assert seen == ["rows", "trim", "rows", "rows"]  # words, then what the whole task has counted


BIG = 2**60


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_nulls(spark, labels, name):
    """Ids above 2^53 come back as they are, also in a batch with null ids."""
    rng = random.Random(13)
    rows = [(BIG + i, prose(rng, 70)) for i in range(1, 6)] + [(None, prose(rng, 70)), (None, prose(rng, 60))]
    got = OPERATORS[name](table(spark, rows).coalesce(1), labels).select("doc_id").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
