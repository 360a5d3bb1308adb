"""Text functions: normal form of words, tokens, range specs, paths and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters that are lower-cased, the Latin letters that look like Cyrillic ones, the letters kept.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
LOWER = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
LOOKALIKE = "aceopxykmthb"
CYRILLIC = "асеорхукмтнв"
OTHER = "[^a-zа-яё]"


def lower_letters(s: Column) -> Column:
    """Lower case of A-Z, А-Я and Ё only."""
    return F.translate(s, UPPER, LOWER)


def fold_lookalikes(s: Column) -> Column:
    return F.translate(s, LOOKALIKE, CYRILLIC)


def keep_letters(s: Column) -> Column:
    return F.regexp_replace(s, OTHER, "")


def collapse_runs(s: Column) -> Column:
    return F.regexp_replace(s, r"(.)\1+", "$1")


def normalise(s: Column) -> Column:
    """The form in which words and dictionary entries are compared."""
    return collapse_runs(keep_letters(fold_lookalikes(lower_letters(F.coalesce(F.make_valid_utf8(s), F.lit(""))))))


def normalise_text(s: str) -> str:
    """normalise() of a Python string, for dictionaries that become literals."""
    folded = s.translate(str.maketrans(UPPER, LOWER)).translate(str.maketrans(LOOKALIKE, CYRILLIC))
    out: list[str] = []
    for c in folded:
        if (("a" <= c <= "z") or ("а" <= c <= "я") or c == "ё") and out[-1:] != [c]:
            out.append(c)
    return "".join(out)


def strip_lead(token: Column) -> Column:
    return F.regexp_replace(token, r"^[ \n]+", "")


def begins_word(token: Column) -> Column:
    return token.rlike(r"^[ \n]")


def parse_range(spec: Column) -> Column:
    """struct<start_ms,end_ms> of "a-b"; null without a dash. Numbers are truncated, what is no number is 0."""
    parts = F.split(spec, "-", 2)

    def number(x: Column) -> Column:
        return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]*\.?[0-9]+|[+-]?[0-9]+)", 1).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))

    return F.when(F.contains(spec, F.lit("-")), F.struct(number(parts[0]).alias("start_ms"), number(parts[1]).alias("end_ms")))


def clean_name(path: Column) -> Column:
    """The default output name of an input file."""
    return F.concat(F.regexp_replace(path, r"(?i)\.[^./\\]*$", ""), F.lit("_clean.wav"))


def flag_line(text: Column, start_ms: Column, end_ms: Column, flagged: Column) -> Column:
    """A transcript row of the report."""
    return F.concat(F.when(flagged, F.lit("  [*] ")).otherwise(F.lit("      ")), F.format_string("[%d-%d ms] %s", start_ms, end_ms, text))
