"""Words and word shingles as hashes, of whole batches of texts at a time.

A word's hash is a polynomial over its bytes, so that one running sum over a batch gives the hashes of
all its words without making a string of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time; a longer word is hashed alone.
PIECE = 1 << 17


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


class Powers:
    """base ** place and its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= PIECE + 2:
            if not len(self.up):
                self.up, self.down = powers(BASE, PIECE + 2), powers(pow(BASE, -1, 2**64), PIECE + 2)
            return self.up[:n], self.down[:n]
        return powers(BASE, n), powers(pow(BASE, -1, 2**64), n)


POWERS = Powers()


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (A-Z lower-cased; only ASCII white space parts words) and where it starts."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):  # back to white space, or else on to it
            gaps = np.flatnonzero(is_space(np.frombuffer(raw, np.uint8, end - at, at)))
            while not len(gaps) and end < len(raw):
                end, before = min(len(raw), 2 * end - at), end
                gaps = np.flatnonzero(is_space(np.frombuffer(raw, np.uint8, end - before, before))) + (before - at)
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        h, s = _piece(b" " + raw[at:end] + b" ")
        hashes.append(h)
        starts.append(s + (at - 1))
        at = end
    if len(hashes) == 1:
        return hashes[0], starts[0]
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data - np.uint8(0x09)) < 5)


def _piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw.lower(), np.uint8)
    space = is_space(data)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, after = edges[0::2], edges[1::2]
    up, down = POWERS.upto(len(data))
    upto = np.cumsum(data * up)
    return mix64((upto[after - 1] - upto[first - 1]) * down[first] + (after - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first


def batches_of(texts: list, limit: int = PIECE) -> Iterator[list]:
    """Runs of texts of about `limit` characters together."""
    some, n = [], 0
    for text in texts:
        some.append(text)
        n += len(text) if text else 0
        if n >= limit:
            yield some
            some, n = [], 0
    if some:
        yield some


def shingle_sets(texts: list[str | None], length: int = 5) -> Iterator[np.ndarray]:
    """Of each text: sorted distinct hashes of the runs of `length` words; of the whole sequence where
    there are fewer words; none without words."""
    for some in batches_of(texts):
        raw = [encoded(t) for t in some]
        ends = np.cumsum([len(r) + 1 for r in raw])
        h, starts = word_hashes(b"\n".join(raw))
        upto = np.searchsorted(starts, ends).tolist()
        runs = _runs(h, length)
        a = 0
        for b in upto:
            n = b - a
            if n >= length:
                s = np.sort(runs[a : b - length + 1])
                yield s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield _runs(h[a:b], n) if n else np.empty(0, np.uint64)
            a = b


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    m = len(h) - n + 1
    acc = np.full(max(m, 0), n, np.uint64)
    for k in range(n if m > 0 else 0):
        acc = mix64(acc * np.uint64(BASE) + h[k : m + k])
    return acc


def shingle_set(text: str | None, length: int = 5) -> np.ndarray:
    return next(shingle_sets([text], length))
