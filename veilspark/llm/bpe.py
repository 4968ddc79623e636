"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding.  An
automaton lists the vocabulary entries that end at each position; the entry whose
predecessor (the last token of the shorter prefix) is compatible with it is that token.
Counts of every prefix and back-pointers fall out of the same table, so truncation and
budget questions need no second encoding.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex

from .common import release

# Fixed values of the vocabulary files' pre-tokenizers.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{s}{l}{n}]+"
SPACES = r"\t-\r \x85\xa0  -     　"
# Letters, digits and spaces below U+0250, where the quicker engine is used.
NARROW = {"l": "A-Za-zªµºÀ-ÖØ-öø-ɏ", "n": "0-9²³¹¼½¾", "s": "\\t-\\r \\x85\\xa0"}

#: Entries a cache may hold before it is emptied; it only bounds memory, never results.
CACHE_LIMIT = 250_000
#: Pieces that a worker keeps the tokens of, before it lets older ones go: up to twice as many are held.
RECENT = 40_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use, as character -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Characters that Python's Unicode version does not know; the library's may be newer."""
    edges, was = [], False  # without a list of all 800,000
    for c in range(0x80, sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free != was:
            edges.append(c)
            was = free
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(edges[::2], edges[1::2])) + "]")


class Fits(dict):
    """(token, next token) -> whether they may stand so in a word, found out as pairs come."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, pair: tuple[int, int]) -> bool:
        left, right = pair
        made = self.bpe.is_whole(right) if left == self.bpe.start else self.bpe.compatible(left, right)
        if len(self) >= CACHE_LIMIT:
            self.clear()
        self[pair] = made
        return made


class PrefixBpe:
    """One vocabulary.  Symbols are bytes; where words have an end mark, the last byte of a
    word is a symbol of its own (256 + byte)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.path, self.alphabet = path, byte_alphabet()
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = self.alphabet

        def symbols(name: str) -> str:
            if self.end and name.endswith(self.end):
                raw = [alphabet[c] for c in name[: -len(self.end)]]
                return "".join(map(chr, raw[:-1])) + chr(256 + raw[-1])
            return "".join(chr(alphabet[c]) for c in name)

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        base = sorted(i for t, i in model["vocab"].items() if t not in made)
        # Ranks order single symbols before merges and merges by priority.
        self.id_of = base + [model["vocab"][a + b] for a, b in pairs]
        rank = {self.names[i]: r for r, i in enumerate(self.id_of)}
        self.text_of = [symbols(self.names[i]) for i in self.id_of]
        self.halves = [(r, r) for r in range(len(base))] + [(rank[a], rank[b]) for a, b in pairs]
        self.merged = {(rank[a], rank[b]): len(base) + n for n, (a, b) in enumerate(pairs)}
        self.n_base = len(base)
        self.single = {self.text_of[r]: r for r in reversed(range(len(base)))}
        self.automaton = ahocorasick.Automaton()
        for r, t in enumerate(self.text_of):
            if len(t) > 1:
                self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()
        self.sizes = list(map(len, self.text_of))
        self.packed = [i.to_bytes(4, "little") for i in self.id_of]
        self.start = len(self.halves)  # stands before a word's first token
        self.fits = Fits(self)
        byte_kind = not self.end
        pieces = BYTE_PIECES if byte_kind else WORD_PIECES
        near = {k: v for k, v in NARROW.items()}
        self.near_pieces = re.compile(pieces.format(L=f"[{near['l']}]", N=f"[{near['n']}]", **near))
        self.far_pieces = regex.compile(pieces.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}", s=SPACES))
        self.wide = re.compile("[^\x00-ɏ]")

    # -- words -------------------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether left followed by right is what encoding their joined text gives: undo the
        merges next to the seam, latest first; no pair across it may have come earlier."""
        ceiling = len(self.halves)
        a, b = left, right
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < ceiling:
                return False
            if a > b:
                # The left side was merged later: open it; its right half now meets the seam.
                if a < self.n_base:
                    return True
                ceiling, a = a, self.halves[a][1]
            else:
                if b < self.n_base:
                    if a < self.n_base:
                        return True
                    ceiling, a = a, self.halves[a][1]
                else:
                    # A merge on the right with the same rank as one across the seam comes later.
                    ceiling, b = b + 1, self.halves[b][0]

    def is_whole(self, token: int) -> bool:
        """Whether a vocabulary entry is the encoding of its own text."""
        if token < self.n_base:
            return True
        parts = [self.single[c] for c in self.text_of[token]]
        while len(parts) > 1:
            best = min((self.merged.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts == [token]

    def last_tokens(self, symbols: str) -> list[int]:
        """The last token of every prefix, by the place of its last symbol; at the end (the place before
        the first symbol, too) stands the start.  Where no entry of several symbols may end, as exactly
        one entry does, it is the symbol itself."""
        last = list(map(self.single.__getitem__, symbols))
        last.append(self.start)
        fits, found = self.fits, -1
        for at, (token, size) in self.automaton.iter(symbols):  # the longest first
            if at != found and fits[last[at - size], token]:
                last[at], found = token, at
        return last

    def counts(self, symbols: str) -> list[int]:
        """Tokens of every prefix, from the empty one."""
        count, sizes = [0], self.sizes
        for at, token in enumerate(self.last_tokens(symbols)[:-1], 1):
            count.append(count[at - sizes[token]] + 1)
        return count

    def symbols(self, piece: str) -> str:
        if piece.isascii():
            return piece[:-1] + chr(256 + ord(piece[-1])) if self.end else piece
        raw = piece.encode("utf-8", "surrogatepass")
        if self.end:
            return raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        return raw.decode("latin-1")

    def word_ids(self, piece: str) -> bytes:
        """32 bits each, little-endian: follows the back-pointers from the end of the piece."""
        last, sizes, packed, out = self.last_tokens(self.symbols(piece)), self.sizes, self.packed, []
        at = len(last) - 2
        while at >= 0:
            token = last[at]
            out.append(packed[token])
            at -= sizes[token]
        out.reverse()
        return b"".join(out)

    def word_count(self, piece: str) -> int:
        last, sizes, n = self.last_tokens(self.symbols(piece)), self.sizes, 0
        at = len(last) - 2
        while at >= 0:
            at -= sizes[last[at]]
            n += 1
        return n

    # -- texts -------------------------------------------------------------------------
    @cached_property
    def spaced(self) -> pa.Array:
        """Token strings by id, each with a space after it."""
        return pa.array([f"{self.names.get(i, '')} ".encode() for i in range(max(self.names) + 1)], pa.large_binary())

    def shown(self, ids: bytes) -> memoryview:
        """Token strings joined by spaces (UTF-8), as a vocabulary without a decoder gives them."""
        if not ids:
            return memoryview(b"")
        found = self.spaced.take(pa.array(np.frombuffer(ids, "<u4")))
        _, ends, data = found.buffers()
        return memoryview(data)[: np.frombuffer(ends, np.int64)[len(found)] - 1]

    def normal(self, text: str) -> str:
        if not self.end:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # character by character: no rule for a sigma at a word's end
                return "".join(c.lower() for c in text)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        return (self.far_pieces if self.wide.search(text) else self.near_pieces).findall(text)

    @cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """Pieces of a text as it is normalized; where it holds characters unknown here, the library
        itself normalizes and cuts it (the encoding of the pieces is ours all the same)."""
        if not (self.end and self.wide.search(text) and unassigned().search(text)):
            return self.pieces(self.normal(text))
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.alphabet.__getitem__, shown)).decode("utf-8") for shown, _ in cut]

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn; special strings stand at odd places."""
        if self.split_special is None or "<|" not in text:
            return [text]
        return self.split_special.split(text)

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:k] for every k from 0, of a byte-level vocabulary, from the tables
        of its pieces.  Special strings count as one token once they are complete."""
        out, base, tail, tail_base = [0], 0, "", 0
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                for m in range(1, len(part)):  # joined with what stands before it, as far as it can join
                    out.append(tail_base + sum(map(self.word_count, self.pieces(tail + part[:m]))))
                tail, tail_base = "", base + 1
                base += 1
                out.append(base)
                continue
            pieces = self.pieces(part)
            tokens, before = [], ""
            for p in pieces:
                tokens.append(base)
                counts = self.counts(self.symbols(p))
                ends, at = [], 0
                for c in p:
                    at += len(c.encode("utf-8", "surrogatepass"))
                    ends.append(counts[at])
                for m in range(1, len(p) + 1):
                    head = p[:m]
                    if before.isspace() and head.isspace():
                        # A run of spaces that the prefix ends in is one piece.
                        out.append(tokens[-2] + sum(map(self.word_count, self.pieces(before + head))))
                    elif head[0] == "'" and m > 1 and len(self.pieces(head)) > 1:
                        out.append(base + sum(map(self.word_count, self.pieces(head))))
                    else:
                        out.append(base + ends[m - 1])
                base += counts[-1]
                before = p
            tail, tail_base = ("".join(pieces[-2:]), tokens[-2:][0]) if pieces else ("", base)
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix that has at most `budget` tokens."""
        counts = self.prefix_counts(text)
        return text[: max(k for k, c in enumerate(counts) if c <= budget)]


class Recent(dict):
    """piece -> what make() gives for it, filled as pieces come.  Workers outlive their stage, and what they
    hold counts in the stages after it, too: when RECENT pieces came, those of before that were not asked for
    meanwhile are let go."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe, self.before = bpe, {}

    def __missing__(self, piece: str):
        made = self.before.get(piece)
        if made is None:
            made = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= RECENT:
                self.before = dict(self)
                self.clear()
            self[piece] = made
        return made


class Counted(Recent):
    """piece -> number of tokens."""

    def make(self, piece: str) -> int:
        return self.bpe.word_count(piece)


class Encoded(Recent):
    """piece -> ids as bytes; their strings are looked up for a whole text."""

    def make(self, piece: str) -> bytes:
        return self.bpe.word_ids(piece)


@lru_cache(maxsize=4)
def load(path: str) -> PrefixBpe:
    """One vocabulary for each worker process, until forget().  What it held for a stage before is given back first."""
    release()
    made = PrefixBpe(path)
    release()
    return made


@lru_cache(maxsize=4)
def counted(path: str) -> Counted:
    return Counted(load(path))


@lru_cache(maxsize=4)
def encoded(path: str) -> Encoded:
    return Encoded(load(path))


def forget() -> None:
    """Lets go of this process's vocabularies and of all pieces it holds: tasks go around among an executor's
    workers, of which there may be more than cores, and idle ones hold what they hold beside other stages."""
    for held in (encoded, counted, load):
        held.cache_clear()
    gc.collect()  # what went in circles pins memory, too


def count_text(path: str, text: str | None) -> int:
    """Tokens of a whole text (null: 0)."""
    if not text:
        return 0
    bpe, cache = load(path), counted(path)
    total = 0
    for k, part in enumerate(bpe.segments(text)):
        total += 1 if k % 2 else sum(map(cache.__getitem__, bpe.words(part)))
    return total


def text_ids(path: str, text: str | None) -> bytes:
    """Ids of a whole text (little-endian, 32 bits each; null: none)."""
    if not text:
        return b""
    bpe, known = load(path), encoded(path).__getitem__
    return b"".join(bpe.special[part].to_bytes(4, "little") if k % 2 else b"".join(map(known, bpe.words(part))) for k, part in enumerate(bpe.segments(text)))


def encode_text(path: str, text: str | None) -> tuple[bytes, str]:
    """Ids as above and the decoded text."""
    ids = text_ids(path, text)
    return ids, str(load(path).shown(ids), "utf-8")
