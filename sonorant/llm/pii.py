"""Personal data: exact base kinds plus weak supervision for further spans (native).

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches with their checks. The method proposes three
kinds of further candidates: code-like tokens (secrets, account and document numbers), names (two or three capitalised
words) and postal addresses (a house number beside capitalised words). Four labelers vote on each candidate, in terms of
its kind: a shape regex, a gazetteer (cue words, given names, street words), the context around it, and its character
mix. For each kind, expectation-maximisation over the counts of vote patterns (at most 3^4 patterns times a few dozen
feature cells, whatever the corpus) estimates each labeler's reliability and a posterior for every cell; a logistic span
classifier is trained on those posteriors and then scores every candidate as a column expression. A candidate that no
labeler takes for personal data is never a span.

Texts are read once: spans and features are written to the shared folder, and both the counts and the answer come from
that small table.

Defined cases: a null text is empty; repeated rows are answered one by one; a text without spans has empty strings; an
empty corpus trains nothing and adds no spans; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorant.llm.common import documents, materialise

KINDS = ("email", "ip", "card", "phone", "secret", "name", "address")
N_BASE = 4

# Patterns as the contract has them, in a form that takes linear time on long runs: a match can begin only where a run
# of its first class begins, or right after the match before it.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CODE = r"A-Za-z0-9+/_-"
CANDIDATE = rf"(?<![{_CODE}])(?=[A-Za-z+/_-]*+[0-9])[{_CODE}]{{9,}}+"
_CAP = r"\p{Lu}[\p{Ll}'\u2019-]++"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?!(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Dear|By|Contact)\b){_CAP}(?:[\x20](?:\p{{Lu}}\.|{_CAP})){{1,2}}+(?![\p{{L}}\p{{N}}])"
ADDRESS = rf"(?<![\p{{L}}\p{{N}}.,])(?:[0-9]{{1,5}}[a-z]?[\x20](?:{_CAP}\.?[\x20]?){{1,4}}+|{_CAP}(?:[\x20]{_CAP}){{0,2}}+[\x20][0-9]{{1,4}}[a-z]?)(?![\p{{L}}\p{{N}}])"
CANDIDATES = (CANDIDATE, NAME, ADDRESS)

# Cue words of the gazetteer labeler for codes; given names, titles and street words for the others.
CUES = ("token", "secret", "password", "passwd", "key", "apikey", "bearer", "ssn", "passport", "iban", "credential")
NEUTRAL = ("version", "isbn", "issue", "page", "chapter", "year", "doi", "commit", "figure")
GIVEN = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul", "Peter", "George", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara",
    "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Anna", "Maria", "Hans", "Karl", "Klaus", "Wolfgang", "Heike", "Sabine", "Monika", "Pierre", "Jean", "Marie", "Sophie", "Claire", "Carlos", "Juan", "Pedro", "Luis", "Carmen", "Ana",
)
NOT_GIVEN = ("The", "This", "That", "In", "On", "At", "It", "Is", "And", "Of", "To", "New", "North", "South", "East", "West", "Monday", "January", "Der", "Die", "Das", "Und", "Le", "La", "Les", "El", "Los", "United", "University", "Chapter")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "monsieur", "madame", "sr", "sra", "name", "called", "signed", "contact", "patient", "dear", "by")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Square", "Way", "Rue", "Calle", "Avenida")
AT = ("at", "address", "lives", "live", "resides", "residing", "anschrift", "wohnhaft", "adresse")


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,m>> of the matches, in code points: pieces between matches give their places."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("gap"), b.alias("m")))
    start = F.expr("named_struct('pos', 0, 'out', CAST(array() AS array<struct<start:int,end:int,m:string>>))")

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("m")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def _chars(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


def _kind(text: Column, guard: Column, pattern: str, ok, kind: int) -> Column:
    none = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    found = F.transform(F.filter(located(text, pattern), lambda s: ok(s["m"])), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(guard, found).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> of the base kinds, by start and then kind."""
    return F.array_sort(F.concat(
        _kind(text, F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True), 0),
        _kind(text, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, _ip_ok, 1),
        _kind(text, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, _card_ok, 2),
        _kind(text, F.contains(text, F.lit("+")), PHONE, lambda m: F.length(_digits(m)).between(10, 15), 3),
    ))


def _cue(before: Column) -> Column:
    """The word before a candidate, in lower case."""
    return F.regexp_extract(F.lower(before), r"(\p{L}+)[^\p{L}\p{N}]{0,4}$", 1)


def _code_votes(m: Column, before: Column, after: Column) -> tuple[list[Column], list[Column]]:
    """Votes of the labelers (1 for personal, -1 for not, 0 for no opinion) and features: length, characters, quotes, cue."""
    cue, n = _cue(before), F.length(m)
    distinct = F.size(F.array_distinct(_chars(m)))
    shape = F.when(m.rlike(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | ((n >= 20) & m.rlike("[0-9]") & m.rlike("[A-Za-z]")), 1).when((n < 12) | m.rlike("^[0-9]+$"), -1).otherwise(0)
    words = F.when(cue.isin(*CUES), 1).when(cue.isin(*NEUTRAL), -1).otherwise(0)
    marks = F.when(before.rlike("[=:]\\s?[\"']?$"), 1).when(before.rlike(r"[a-zà-ÿ.,]\s$") & after.rlike(r"^\s"), -1).otherwise(0)
    mix = F.when((distinct >= 11) & m.rlike("[a-zA-Z]"), 1).when(distinct <= 10, -1).otherwise(0)
    size = F.when(n < 12, 0).when(n < 20, 1).when(n < 32, 2).otherwise(3)
    chars = F.when(m.rlike("^[0-9]+$"), 0).when(m.rlike("^[0-9a-fA-F]+$"), 1).when(m.rlike("^[0-9A-Za-z]+$"), 2).otherwise(3)
    return [shape, words, marks, mix], [size, chars, before.rlike("[\"']$").cast("int"), cue.isin(*CUES).cast("int")]


def _name_votes(m: Column, before: Column, after: Column) -> tuple[list[Column], list[Column]]:
    """As _code_votes; features: words, first word, title before, sentence start."""
    parts = F.split(m, " ")
    first, cue = F.get(parts, F.lit(0)), _cue(before)
    opens = before.rlike(r"(^|[.!?\n]\s*)$")
    shape = F.when(m.rlike(r" \p{Lu}\. "), 1).when(m.rlike(r"\p{Ll}{16}"), -1).otherwise(0)
    words = F.when(first.isin(*GIVEN), 1).when(first.isin(*NOT_GIVEN), -1).otherwise(0)
    context = F.when(cue.isin(*TITLES), 1).when(opens, -1).otherwise(0)
    mix = F.when(after.rlike(r"^(,|'s|\s*[(<])") & ~opens & first.isin(*GIVEN), 1).when(F.length(m) > 40, -1).otherwise(0)
    kind = F.when(first.isin(*GIVEN), 0).when(first.isin(*NOT_GIVEN), 1).otherwise(2)
    return [shape, words, context, mix], [F.least(F.size(parts), F.lit(3)), kind, cue.isin(*TITLES).cast("int"), opens.cast("int")]


def _address_votes(m: Column, before: Column, after: Column) -> tuple[list[Column], list[Column]]:
    """As _code_votes; features: order, length, street word, cue."""
    parts, cue = F.split(F.regexp_replace(m, r"\.", ""), " "), _cue(before)
    street = F.exists(parts, lambda p: p.isin(*STREETS)) | m.rlike("(?i)(stra(ß|ss)e|str|weg|platz|allee|gasse)\\b")
    ahead = m.rlike("^[0-9]")
    shape = F.when(street & (ahead | m.rlike("[0-9][a-z]?$")), 1).when(m.rlike(r"\p{Ll}{20}"), -1).otherwise(0)
    words = F.when(street, 1).otherwise(-1)
    context = F.when(cue.isin(*AT) | after.rlike(r"^,\s*(\p{Lu}|[0-9]{4,5})"), 1).when(before.rlike(r"[.!?]\s*$"), -1).otherwise(0)
    mix = F.when(street & (F.length(m) <= 40), 1).when(F.length(m) > 40, -1).otherwise(0)
    return [shape, words, context, mix], [ahead.cast("int"), F.least(F.size(parts), F.lit(3)), street.cast("int"), cue.isin(*AT).cast("int")]


VOTERS = (_code_votes, _name_votes, _address_votes)
N_VOTES, LEVELS = 4, (4, 4, 2, 2)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind,start,end,v,f>> of the candidates that touch no base span; kind counts from 0 for codes."""
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,end:int,v:array<int>,f:array<int>>>)")

    def of(kind: int) -> Column:
        def described(s: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), s["start"] - 23), F.least(F.lit(24), s["start"]))
            after = F.substring(text, s["end"] + 1, F.lit(8))
            v, f = VOTERS[kind](s["m"], before, after)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*[x.cast("int") for x in v]).alias("v"), F.array(*[x.cast("int") for x in f]).alias("f"))

        free = F.filter(located(text, CANDIDATES[kind]), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.when(text.rlike("[0-9]") if kind == 0 else text.rlike(CANDIDATES[kind]), F.transform(free, described)).otherwise(none)

    return F.concat(*[of(k) for k in range(len(CANDIDATES))])


def fit_reliabilities(cells: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict[tuple[int, int], float]], list[float]]:
    """EM over (votes, count): the prior, each labeler's P(vote | class), each cell's posterior."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in cells]
    prior, tables = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * p for (_, n), p in zip(cells, post)), sum(n * (1 - p) for (_, n), p in zip(cells, post))]
        prior = min(0.99, max(0.01, mass[0] / max(mass[0] + mass[1], 1e-9)))
        tables = []
        for k in range(N_VOTES):
            t = {}
            for c in (0, 1):
                seen = {x: 1.0 + sum(n * (p if c == 0 else 1 - p) for (v, n), p in zip(cells, post) if v[k] == x) for x in (-1, 0, 1)}
                t |= {(c, x): y / sum(seen.values()) for x, y in seen.items()}
            tables.append(t)
        post = []
        for v, _ in cells:
            a = math.log(prior) + sum(math.log(t[0, x]) for t, x in zip(tables, v))
            b = math.log(1 - prior) + sum(math.log(t[1, x]) for t, x in zip(tables, v))
            post.append(1 / (1 + math.exp(max(-700.0, min(700.0, b - a)))))
    return prior, tables, post


def fit_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300) -> tuple[float, dict[tuple[int, int], float]]:
    """Logistic regression on (features, posterior, count) with one weight for each feature's level."""
    bias, w = 0.0, {(i, x): 0.0 for i, n in enumerate(LEVELS) for x in range(n)}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        gb, gw = 0.0, dict.fromkeys(w, 0.0)
        for f, p, n in rows:
            z = bias + sum(w[i, x] for i, x in enumerate(f))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            gb += e
            for i, x in enumerate(f):
                gw[i, x] += e
        bias -= 2.0 * gb
        w = {k: y - 2.0 * (gw[k] + 1e-4 * y) for k, y in w.items()}
    return bias, w


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of struct<start,kind,end>; kind is an index of KINDS) for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    seen = materialise(seen.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("cand")), "pii-spans")
    # At most 81 vote patterns x 64 feature cells come back for each kind, whatever the corpus.
    counts = seen.select(F.explode("cand").alias("c")).groupBy("c.kind", "c.v", "c.f").agg(F.count(F.lit(1)).alias("n")).collect()
    cand = F.col("cand")
    extra = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    for kind in range(len(CANDIDATES)):
        cells = sorted((tuple(r["v"]), tuple(r["f"]), float(r["n"])) for r in counts if r["kind"] == kind)
        if cells:
            extra = F.concat(extra, F.transform(F.filter(cand, _personal(kind, cells)), lambda c: F.struct(c["start"].alias("start"), F.lit(N_BASE + kind).alias("kind"), c["end"].alias("end"))))
    return seen.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _personal(kind: int, cells: list[tuple[tuple[int, ...], tuple[int, ...], float]]):
    """The trained test of one kind's candidates."""
    _, _, post = fit_reliabilities([(v, n) for v, _, n in cells])
    bias, weight = fit_classifier([(f, p, n) for (_, f, n), p in zip(cells, post)])
    tables = [F.array(*[F.lit(weight[i, x]) for x in range(n)]) for i, n in enumerate(LEVELS)]

    def test(c: Column) -> Column:
        z = F.lit(bias)
        for i, t in enumerate(tables):
            z = z + F.get(t, F.get(c["f"], F.lit(i)))
        return (c["kind"] == kind) & F.array_contains(c["v"], 1) & (z >= 0)

    return test


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))

    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}")

    counts = [of(k) for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def brute_base(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds by the contract's own patterns; for tests."""

    def luhn_ok(d: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn_ok(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)
