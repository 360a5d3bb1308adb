"""The dictionary of words to conceal: defaults, extension and table form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sonorant.functions.text import normalise_text

# The default entries of the filter. Roots match inside a word, words match whole.
ROOTS = (
    "хуй", "хуя", "хую", "хуе", "хуё", "хуи", "хуйн",
    "пизд", "бля", "блят", "залуп",
    "мудак", "мудил", "мудач",
    "еба", "ебал", "ебан", "ебуч", "ебет", "еби",
    "ёба", "ёбал", "ёбан", "ёбуч", "ёбет", "ёби",
    "долбоеб", "долбоёб", "уебан", "уёбан", "еблан",
    "гандон", "гондон", "пидор", "пидар", "педик", "пидр",
    "сука", "суки", "сучк",
    "ахуе", "охуе", "нахуй", "похуй", "хуев", "хуёв",
    "манда", "шлюх", "мразь", "тварь", "говн", "дерьм",
    "жоп", "срак", "срат", "ссат", "дроч",
)
WORDS = (
    "fuck", "fucking", "fucked", "fucker", "shit", "shitty", "bitch",
    "bastard", "asshole", "dick", "pussy", "cunt", "faggot", "nigger",
    "nigga", "motherfucker", "cocksucker", "whore", "slut",
)


@dataclass(frozen=True)
class Dictionary:
    """Entries in normal form; empty ones are dropped."""

    roots: tuple[str, ...] = field(default_factory=lambda: tuple(map(normalise_text, ROOTS)))
    words: tuple[str, ...] = field(default_factory=lambda: tuple(map(normalise_text, WORDS)))

    def with_root(self, root: str) -> Dictionary:
        entry = normalise_text(root)
        return Dictionary(self.roots + ((entry,) if entry else ()), self.words)

    def with_word(self, word: str) -> Dictionary:
        entry = normalise_text(word)
        return Dictionary(self.roots, self.words + ((entry,) if entry else ()))

    def minimal_roots(self) -> tuple[str, ...]:
        """Roots that contain no other root; they match the same words."""
        distinct = dict.fromkeys(self.roots)
        return tuple(r for r in distinct if not any(o != r and o in r for o in distinct))

    def table(self, spark: SparkSession) -> DataFrame:
        """entry, mode ('substring' or 'whole')."""
        return spark.createDataFrame([(r, "substring") for r in self.roots] + [(w, "whole") for w in self.words], "entry string, mode string")
