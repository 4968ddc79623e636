"""Comparable forms of names: folding, tokens, keys and search patterns.

Unicode folding has no built-in in Spark, so it is one Arrow UDF; everything derived from the
folded text (tokens, keys, equality) is built-in expressions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Spacing diacritics and the combining marks that they stand for, and the spaces that
# count as a plain one.
SPACING = {0xA8: 0x308, 0xB4: 0x301, 0x60: 0x300, 0x2C6: 0x302, 0x2DC: 0x303, 0x2DA: 0x30A, 0xB8: 0x327, 0x2C7: 0x30C}
SPACES = (0xA0, 0x2007, 0x202F)
BETWEEN_TOKENS = r"[\s,]+"
LEFT, RIGHT = r"(?<!\w)(?:", r")(?!\w)"
#: Runs of word characters, and what BETWEEN_TOKENS leaves.
WORDS, TOKENS = re.compile(r"\w+"), re.compile(r"[^\s,]+")
#: Names of more tokens are searched for in the written and the reversed order only.
MOST_PERMUTED = 4


class FoldTable(dict):
    """Character -> its folded form, found once for each character."""

    def __missing__(self, c: str) -> str:
        code = ord(c)
        base = " " if code in SPACES else chr(SPACING.get(code, code))
        self[c] = made = "".join(d for d in unicodedata.normalize("NFD", base) if unicodedata.category(d) != "Mn").casefold()
        return made


FOLDED = FoldTable()


class CodeTable(dict):
    """The same by code point, as str.translate asks for it."""

    def __missing__(self, code: int) -> str:
        self[code] = made = FOLDED[chr(code)]
        return made


BY_CODE = CodeTable()


def fold(text: str, unescape: bool = True) -> str:
    """Entities resolved, accents and case folded, white space collapsed and trimmed."""
    composed = unicodedata.normalize("NFC", html.unescape(text) if unescape else text)
    return " ".join(composed.translate(BY_CODE).split())


def tokens_of(name: str) -> list[str]:
    return [t for t in fold(name).replace(",", " ").split(" ") if t]


def key_of(name: str) -> tuple[str, ...]:
    return tuple(sorted(tokens_of(name)))


def orders_of(tokens: list[str]) -> set[tuple[str, ...]]:
    return set(permutations(tokens)) if len(tokens) <= MOST_PERMUTED else {tuple(tokens), tuple(reversed(tokens))}


def pattern_of(name: str) -> str:
    """A regular expression that finds the name in folded text: whole words, tokens in any order."""
    return pattern_from(tokens_of(name))


def pattern_from(tokens: list[str]) -> str:
    spelled = [BETWEEN_TOKENS.join(re.escape(t) for t in order) for order in orders_of(tokens)]
    if not any(spelled):
        raise ValueError("a name without tokens cannot be searched for")
    spelled.sort()
    spelled.sort(key=len, reverse=True)  # an engine takes the first alternative that fits
    return LEFT + "|".join(spelled) + RIGHT


def tokens_in(pattern: str) -> list[str]:
    """The tokens that pattern_from made a pattern of; none where it did not make it."""
    if not (pattern.startswith(LEFT) and pattern.endswith(RIGHT)):
        return []
    order = re.match(r"(?:\\.|[^|\\])*", pattern[len(LEFT) : -len(RIGHT)], re.S)[0]
    tokens = [re.sub(r"\\(.)", r"\1", t, flags=re.S) for t in order.split(BETWEEN_TOKENS)]
    return tokens if all(tokens) and pattern_from(tokens) == pattern else []


def anchor_of(tokens: list[str]) -> str:
    """The longest run of word characters in tokens.  Where the tokens stand as whole words, it is a
    whole run of the text, too; "" where there is none to look for."""
    return max((w for t in tokens for w in WORDS.findall(t)), key=lambda w: (len(w), w), default="")


class Finder:
    """Many patterns, searched for by their anchors: only those whose anchor stands in a text are tried,
    and only at the tokens around it.  Patterns without an anchor are tried on the whole text."""

    def __init__(self, patterns: Iterable[str | None]):
        self.at: dict[str, list[tuple[int, int, str]]] = {}
        self.rest: list[tuple[int, str]] = []
        for k, p in enumerate(patterns):
            if not p:
                continue
            tokens = tokens_in(p)
            if word := anchor_of(tokens):
                self.at.setdefault(word, []).append((k, len(tokens) - 1, p))
            else:
                self.rest.append((k, p))

    def subjects(self, text: str) -> set[int]:
        """Numbers of the patterns that match anywhere in a folded text."""
        found = {k for k, p in self.rest if compiled(p).search(text)}
        if not self.at or not (words := self.at.keys() & set(WORDS.findall(text))):
            return found
        tokens = [m.span() for m in TOKENS.finditer(text)]
        for i, (start, stop) in enumerate(tokens):
            for word in words.intersection(WORDS.findall(text, start, stop)):
                for k, others, p in self.at[word]:
                    # A match has as many neighbouring tokens as its pattern, this one among them.
                    if k not in found and compiled(p).search(text[tokens[max(i - others, 0)][0] : tokens[min(i + others, len(tokens) - 1)][1]]):
                        found.add(k)
        return found


@lru_cache(maxsize=2)
def finder(patterns: tuple[str | None, ...]) -> Finder:
    return Finder(patterns)


def fold_glyphs(glyphs: list[str]) -> tuple[str, list[int]]:
    """Folded text of single glyphs with, for each of its characters, the glyph it came from.  No
    composition, entities or collapsing: every glyph keeps its place."""
    text, origin = [], []
    for at, g in enumerate(glyphs):
        folded = FOLDED[g] if len(g) == 1 else "".join(map(FOLDED.__getitem__, g))
        folded = " " if folded.isspace() else folded
        text.append(folded)
        origin += [at] * len(folded)
    return "".join(text), origin


# -- columns -------------------------------------------------------------------------------


def fold_text(text: Column, unescape: bool = True) -> Column:
    """fold() of a column; null stays null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else fold(t, unescape))

    return run(text)


def tokens(folded: Column) -> Column:
    return F.array_remove(F.split(F.translate(folded, ",", " "), " "), "")


def name_key(folded: Column) -> Column:
    """Order-free identity of a folded name: its sorted tokens, repeats kept."""
    return F.array_sort(tokens(folded))


def same_name(key: Column, other: Column) -> Column:
    return (F.size(key) > 0) & (key == other)


def search_pattern(name: Column) -> Column:
    """pattern_of() of a column; null for names without tokens."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: pattern_of(n) if n and tokens_of(n) else None)

    return run(name)


def spans(folded: Column, patterns: Column) -> Column:
    """array<struct<subject, start, end>> of all matches of an array of patterns, by code point."""

    @F.pandas_udf("array<struct<subject:int,start:int,stop:int>>")
    def run(texts: pd.Series, many: pd.Series) -> pd.Series:
        return pd.Series([[{"subject": k, "start": m.start(), "stop": m.end()} for k, p in enumerate(ps) if p for m in compiled(p).finditer(t or "")] for t, ps in zip(texts, many)])

    return run(folded, patterns)


class Compiled(dict):
    def __missing__(self, pattern: str) -> re.Pattern:
        if len(self) > 10_000:
            self.clear()
        self[pattern] = made = re.compile(pattern)
        return made


_COMPILED = Compiled()


def compiled(pattern: str) -> re.Pattern:
    return _COMPILED[pattern]
