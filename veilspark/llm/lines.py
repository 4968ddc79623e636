"""Line dedup as an exact set-similarity join.

A line is its set of words.  All words have one global order, rare ones first; two lines of Jaccard
similarity t or more share a word within short prefixes in that order, so only lines that meet at a
prefix word are compared.  Pairs must pass the length filter, the positional filter (what the places of
the shared word still allow) and a parity filter (128 bits whose differences are at most the words not
shared); what passes is verified on the lines themselves.  A line goes if an earlier line has its set or
is verified similar.

Rows travel as packed columns, a block for each task and bucket of words, so that a shuffle moves few
large rows.  A word's lines are swept together; each line looks for its LISTED earliest
partners, which are verified.  Only lines that are like none of them though they have more, and words with
over CROWD lines, go on to a second round: there lines meet in blocks, those of a crowded word
at pairs of prefix words (similar lines share two of them), and every partner is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, freeing, fresh, slices, slots, stored
from .quality import let
from .shingles import encoded, mix64, word_hashes

#: Lines of fewer words are left alone: those without any.
LEAST_WORDS = 1
SIMILARITY = 0.8
#: Counters of the word order: hashed, so their number is fixed whatever the vocabulary.  Words that
#: share one are ordered by hash; any order is exact, a rarer-first one is quick.
COUNTERS = 1 << 18
#: Earlier partners of a line that are verified at first.
LISTED = 4
#: Lines of one word that are swept together; a word with more goes to the second round.
CROWD = 4096
#: Lines of a pair of words that meet as many others at a time in the second round.
BLOCK = 1024
#: Bytes of text whose lines are packed together by a task, and prefix rows of a bucket, about.
RUN, BUCKET_ROWS = 2 << 20, 250_000
#: Tasks that sweep buckets, for each partition of a shuffle.
TASKS = 2
#: Lines sorted together: their number takes 16 bits of a sort key.
SORTED = 1 << 16


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of integers as one block, each in the fewest bytes that hold it."""
    head, body = [len(columns[0])], []
    for c in columns:
        c = c.astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64)
        low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
        kind = next(k for k in (1, 2, 4, 8) if high - low < 1 << 8 * k)
        head += [low, kind]
        body.append((c.view(np.uint64) - np.uint64(low & (2**64 - 1))).astype(f"u{kind}").tobytes())
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(block: bytes, n: int) -> list[np.ndarray]:
    head = np.frombuffer(block, np.int64, 1 + 2 * n)
    rows, at, out = int(head[0]), 8 * (1 + 2 * n), []
    for low, kind in head[1:].reshape(n, 2).tolist():
        out.append((np.frombuffer(block, f"u{kind}", rows, at).astype(np.uint64) + np.uint64(low & (2**64 - 1))).view(np.int64))
        at += rows * kind
    return out


Pieces = list[tuple[int, int, bytes]]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    """Document id, number of its first line and text of pieces, RUN bytes of them at a time; longer
    texts are cut between lines."""
    pieces, n = [], 0
    for b in slices(batches):
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            first, left = 0, encoded(text)
            while left is not None:
                cut = left.find(b"\n", RUN) if len(left) > RUN else -1
                part, left = (left, None) if cut < 0 else (left[:cut], left[cut + 1 :])
                pieces.append((doc, first, part))
                first += part.count(b"\n") + 1
                n += len(part)
                if n >= RUN:
                    yield pieces
                    pieces, n = [], 0
    if pieces:
        yield pieces


def numbered(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Document id and number of every line."""
    each = np.fromiter((p[2].count(b"\n") + 1 for p in pieces), np.int64, len(pieces))
    own = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(np.array([p[0] for p in pieces], np.int64), each), own + np.repeat(np.array([p[1] for p in pieces], np.int64), each)


class Lines:
    """The lines of some texts that hold enough words, as sets of words in the global order.

    A word's code is 8 bits for its rarity and 40 of its hash.
    """

    def __init__(self, pieces: Pieces, levels: np.ndarray, least: int):
        joined = b"\n".join(p[2] for p in pieces)
        h, starts = word_hashes(joined)
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), len(joined))
        upto = np.searchsorted(starts, ends)
        sizes = np.diff(upto, prepend=0)
        doc, number = numbered(pieces)
        line = np.flatnonzero(sizes >= max(least, 1))
        self.doc, self.number = doc[line], number[line]
        words = np.repeat(sizes >= max(least, 1), sizes)
        h, own = h[words], sizes[line]
        code = (levels[h & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        parts, at = [], np.concatenate([[0], np.cumsum(own)])
        for a in range(0, len(line), SORTED):
            b = min(a + SORTED, len(line))
            key = (np.repeat(np.arange(b - a, dtype=np.uint64), own[a:b]) << np.uint64(48)) | code[at[a] : at[b]]
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            parts.append(((key >> np.uint64(48)).astype(np.int64) + a, key & np.uint64(2**48 - 1)))
        self.line, self.code = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.uint64))
        self.sizes = np.bincount(self.line, minlength=len(line))
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = lambda salt: np.add.reduceat(mix64(self.code ^ np.uint64(salt)), self.starts) if len(line) else np.empty(0, np.uint64)
        self.digest = total(0x5851F42D4C957F2D), total(0xD1342543DE82EF95)

    def parity(self) -> list[np.ndarray]:
        return [np.bitwise_xor.reduceat(b, self.starts) if len(self.starts) else b for b in bits_of(self.code)]

    def places(self) -> np.ndarray:
        return np.arange(len(self.code)) - self.starts[self.line]

    def reach(self, t: float) -> np.ndarray:
        """Length of each line's prefix; none where only equal sets are similar enough."""
        return np.where(self.sizes >= t * (self.sizes + 1) - 1e-9, self.sizes - np.ceil(t * self.sizes - 1e-9).astype(np.int64) + 1, 0)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a line has the first place here of its set, and whether its place is a later one."""
        order, first = leaders(self.digest, self.doc, self.number)
        later = order[(self.doc[order] != self.doc[first]) | (self.number[order] != self.number[first])]
        return marked(first, len(self.doc)), marked(later, len(self.doc))


def bits_of(code: np.ndarray) -> list[np.ndarray]:
    """One of 128 bits for each word, as two numbers."""
    bit, high = np.uint64(1) << (code & np.uint64(63)), (code & np.uint64(64)) > 0
    return [np.where(high, np.uint64(0), bit), np.where(high, bit, np.uint64(0))]


def word_ids(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, 32 bits within it, and both as one number.  Words that share them only meet needlessly."""
    m = mix64(code)
    bucket, key = ((m & np.uint64(0x7FFFFFFF)) % np.uint64(buckets)).astype(np.int64), (m >> np.uint64(32)).astype(np.int64)
    return bucket, key, (key << 31) | bucket


def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> blocks of word counts."""
    total = np.zeros(COUNTERS, np.int64)
    for pieces in runs(batches):
        h, _ = word_hashes(b"\n".join(p[2] for p in pieces))
        total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    part = COUNTERS // 64
    yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([pack([total[k * part : (k + 1) * part]]) for k in range(64)], pa.binary())], names=["part", "block"])


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of word counts -> their sums."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[part] = held.get(part, 0) + unpack(block, 1)[0]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack([v]) for v in held.values()], pa.binary())], names=["part", "block"])


#: What a block holds: the first places of sets, prefix words, and places that go.
FIRSTS, PREFIXES, GONE = 0, 1, 2
COLUMNS = {FIRSTS: 4, PREFIXES: 8, GONE: 2}
BLOCKS = "bucket int, kind int, block binary"


def packer(t: float, least: int, levels: np.ndarray, buckets: int):
    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> blocks, by bucket."""
        for pieces in runs(batches):
            s = Lines(pieces, levels, least)
            if not len(s.doc):
                continue
            new, later = s.firsts()
            out: list[tuple[int, int, bytes]] = []
            if later.any():
                out.append((int(s.digest[0][0] % np.uint64(buckets)), GONE, pack([s.doc[later], s.number[later]])))
            d1, d2 = s.digest
            split(out, FIRSTS, (d1[new] % np.uint64(buckets)).astype(np.int64), [d1[new], d2[new], s.doc[new], s.number[new]])
            use = (s.places() < s.reach(t)[s.line]) & new[s.line]
            line = s.line[use]
            bucket, key, _ = word_ids(s.code[use], buckets)
            split(out, PREFIXES, bucket, [key, s.doc[line], s.number[line], s.sizes[line], s.places()[use], (d1 >> np.uint64(32))[line], *(x[line] for x in s.parity())])
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["bucket", "kind", "block"])

    def split(out: list, kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> None:
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
            if b > a:
                out.append((int(bucket[a]), kind, pack([c[a:b] for c in columns])))

    return packs


def differing(parity, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows x and y differ: at most the words that they do not share."""
    return sum(np.bitwise_count((p[x] ^ p[y]).view(np.uint64)) for p in parity)


MET = "kind int, doc_a long, line_a int, doc_id long, line int, word long"
#: What a row of MET is: a place that goes, a later line and an earlier one that it may be like, a crowded word.
GOES, MEETS, CROWDED = 0, 1, 2


def sweeper(t: float, buckets: int):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks sorted by bucket -> MET."""
        bucket, held = None, Bucket()
        for b in slices(batches, 64):  # blocks are large
            for k, kind, block in zip(*[c.to_pylist() for c in b.columns]):
                if k != bucket:
                    yield from finish(held, bucket)
                    bucket, held = k, Bucket()
                if kind == GONE:
                    yield met(GOES, *unpack(block, 2))
                elif held.add(kind, block):
                    yield met(GOES, *held.compact())
        yield from finish(held, bucket)

    def finish(held: Bucket, bucket: int | None) -> Iterator[pa.RecordBatch]:
        if bucket is None:
            return
        yield met(GOES, *held.compact(True))
        yield met(CROWDED, word=(held.many << 31) | bucket)
        key, doc, line, size, place, _, *parity = held.columns(PREFIXES)
        order = np.argsort((key << 20) + np.minimum(size, (1 << 20) - 1), kind="stable")
        key, doc, line, size, place, *parity = (c[order] for c in (key, doc, line, size, place, *parity))
        first, later, more = earliest(key, place_codes(doc, line), size, place, parity, t)
        yield met(MEETS, doc[later], line[later], doc[first], line[first], np.where(more, (key[later] << 31) | bucket, -1))

    return sweep


class Bucket:
    """Rows of a bucket; compact() leaves the first place of each set, and no words that are crowded."""

    def __init__(self):
        self.blocks: dict[int, list[list[np.ndarray]]] = {FIRSTS: [], PREFIXES: []}
        self.rows, self.limit, self.many = 0, 4 * BUCKET_ROWS, np.empty(0, np.int64)

    def add(self, kind: int, block: bytes) -> bool:
        """Whether there are so many rows now that they need to be compacted."""
        columns = unpack(block, COLUMNS[kind])
        if kind == PREFIXES and len(self.many):
            at = np.minimum(np.searchsorted(self.many, columns[0]), len(self.many) - 1)
            columns = [c[self.many[at] != columns[0]] for c in columns]
        self.blocks[kind].append(columns)
        self.rows += len(columns[0])
        return self.rows > self.limit

    def columns(self, kind: int) -> list[np.ndarray]:
        found = self.blocks[kind]
        return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * COLUMNS[kind]

    def compact(self, final: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The places of sets but the first of each."""
        d1, d2, doc, line = self.columns(FIRSTS)
        order, first = leaders((d1, d2), doc, line)
        gone = order[(doc[order] != doc[first]) | (line[order] != line[first])]
        went = doc[gone], line[gone]
        self.blocks[FIRSTS] = [[c[marked(first, len(d1))] for c in (d1, d2, doc, line)]]
        columns = self.columns(PREFIXES)
        if final:  # words of one row meet nothing
            order, n = run_lengths(columns[0])
            columns = [c[order[n > 1]] for c in columns]
        key, _, _, size, _, digest, low, high = columns
        _, first = leaders(((key << 32) | digest, size ^ low, high), columns[1], columns[2])
        columns = [c[marked(first, len(columns[0]))] for c in columns]
        order, n = run_lengths(columns[0])
        self.many = np.array(sorted({*self.many.tolist(), *columns[0][order[n > CROWD]].tolist()}), np.int64)
        self.blocks[PREFIXES] = [[c[order[n <= CROWD]] for c in columns]]
        self.rows = len(self.blocks[PREFIXES][0][0]) + len(self.blocks[FIRSTS][0][0])
        self.limit = max(self.limit, 2 * self.rows)
        return went


def leaders(keys: tuple[np.ndarray, ...], doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and for each of them the row with its keys that has the earliest place."""
    order = np.lexsort((place_codes(doc, line), *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order


def marked(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n rows is one of these."""
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def run_lengths(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by key, and for each of them how many rows have its key."""
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else order
    n = np.diff(np.append(new, len(key)))
    return order, np.repeat(n, n)


def place_codes(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Numbers in the order of the places, equal where they are."""
    if not len(doc):
        return doc
    if (int(doc.max()) - int(doc.min()) + 1) * (int(line.max()) + 1) < 1 << 62:
        return (doc - doc.min()) * (int(line.max()) + 1) + line
    order = np.lexsort((line, doc))
    step = np.zeros(len(order), np.int64)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(step)
    return code


def earliest(key, at, size, place, parity, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by word and size: pairs of the LISTED earliest rows that a row may be like and is
    later than, that row, and whether it has more of them."""
    n = len(key)
    best, partners = np.full((n, LISTED), np.iinfo(np.int64).max), np.zeros(n, np.int64)
    order = np.argsort(at, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(at[order][1:] != at[order][:-1])
    mark = (rank << 32) | np.arange(n)
    spare, least = size - place, t * size - 1e-9
    j = np.arange(n)
    for d in range(1, n):
        j = j[j >= d]
        i = j - d
        go = (key[j] == key[i]) & (size[i] >= least[j])
        j, i = j[go], i[go]
        if not len(j):
            break
        need = t / (1 + t) * (size[j] + size[i]) - 1e-9  # words shared by lines that are similar enough
        ok = np.minimum(spare[j], spare[i]) >= need
        later, first, need = j[ok], i[ok], need[ok]
        ok = differing(parity, later, first) <= size[later] + size[first] - 2 * need
        later, first = later[ok], first[ok]
        for x, y in ((later, first), (first, later)):  # a row stands once on either side
            use = rank[y] < rank[x]
            x, new = x[use], mark[y[use]]
            partners[x] += 1
            nearer = new < best[x, -1]
            x, new = x[nearer], new[nearer]
            best[x, -1] = new
            best[x] = np.sort(best[x], axis=1)
    got = best < np.iinfo(np.int64).max
    later, slot = np.nonzero(got)
    return best[later, slot] & 0xFFFFFFFF, later, partners[later] > LISTED


def met(kind: int, doc=(), line=(), doc_a=None, line_a=None, word=None) -> pa.RecordBatch:
    n = len(word) if word is not None else len(doc)
    zero = np.zeros(n, np.int64)
    arrays = [np.full(n, kind, np.int32), zero if doc_a is None else doc_a, (zero if line_a is None else line_a).astype(np.int32), doc if len(doc) else zero, (line if len(line) else zero).astype(np.int32), zero if word is None else word]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in MET.split(", ")])


def place_ids(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a place, for sieves."""
    return (mix64(doc.astype(np.int64).view(np.uint64)) + line.astype(np.int64).view(np.uint64)).view(np.int64)


def in_sieve(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = slots(ids)
    return (bits[at // 8] >> (7 - at % 8)) & 1 == 1


def words_of(line: bytes) -> set[bytes]:
    return set(line.lower().split())


def similar(x: set, y: set, t: float) -> bool:
    both = len(x & y)
    return both >= t * (len(x) + len(y) - both) - 1e-9


def verifier(t: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [(doc, line) for doc, line, x, y in zip(*[c.to_pylist() for c in b.columns]) if similar(words_of(x), words_of(y), t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int32())], names=["doc_id", "line"])

    return verify


def verified(texts: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """Pairs of places -> later places whose lines are similar enough to the earlier ones."""
    places = pairs.select(F.col("doc_a").alias("doc_id"), F.col("line_a").alias("line")).union(pairs.select("doc_id", "line"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place_ids(np.asarray(b.column(0)), np.asarray(b.column(1))))], names=["id"])

    bits = Sieve(places.mapInArrow(freeing(hashed), "id long")).bits

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> their lines that the sieve lets through: hardly any others are moved."""
        for pieces in runs(batches):
            doc, number = numbered(pieces)
            hit = np.flatnonzero(in_sieve(bits, place_ids(doc, number))).tolist()
            split = b"\n".join(p[2] for p in pieces).split(b"\n") if hit else []
            rows = [(int(doc[k]), int(number[k]), split[k]) for k in hit]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "line", "words"])

    lines = stored(texts.mapInArrow(freeing(wanted), "doc_id long, line int, words binary"))
    first = lines.select(F.col("doc_id").alias("doc_a"), F.col("line").alias("line_a"), F.col("words").alias("words_a"))
    full = pairs.join(first, ["doc_a", "line_a"]).join(lines, ["doc_id", "line"])
    return full.select("doc_id", "line", "words_a", "words").mapInArrow(freeing(verifier(t)), "doc_id long, line int").distinct()


CROWD_ROWS = "key long, doc_id long, line int, codes binary"


def crowd_rows(t: float, least: int, levels: np.ndarray, buckets: int, some: np.ndarray, crowded: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> a row for each prefix word in the sieve `some` and, in the sieve `crowded`, for each
        pair of such a word and a later one of a prefix one longer, with the line's words."""
        for pieces in runs(batches):
            s = Lines(pieces, levels, least)
            if not len(s.doc):
                continue
            reach, place = s.reach(t), s.places()
            held = np.flatnonzero((place < reach[s.line]) & s.firsts()[0][s.line])
            word = word_ids(s.code[held], buckets)[2]
            many = in_sieve(crowded, word)
            few, held = held[in_sieve(some, word) & ~many], held[many]
            line = s.line[held]
            after = np.minimum(reach[line] + 1, s.sizes[line]) - place[held] - 1  # words that may be the second one
            one = np.ceil(t * s.sizes[line] - 1e-9) < 2
            first = np.repeat(held, after)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
            key = np.concatenate([mix64(mix64(s.code[first]) + s.code[second]), mix64(s.code[held[one]]), mix64(~s.code[few])]).view(np.int64)
            line = np.concatenate([s.line[first], line[one], s.line[few]])
            for at in range(0, len(key), 10_000):
                part = line[at : at + 10_000]
                codes = [s.code[a : a + n].tobytes() for a, n in zip(s.starts[part].tolist(), s.sizes[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 10_000]), pa.array(s.doc[part]), pa.array(s.number[part].astype(np.int32)), pa.array(codes, pa.binary())], names=[c.split()[0] for c in CROWD_ROWS.split(", ")])

    return rows


def crowd_checker(t: float):
    def check(group: pa.Table) -> pa.Table:
        """Lines of two blocks that share a pair of words -> those that are like an earlier one."""
        order = np.lexsort((np.asarray(group["line"]), np.asarray(group["doc_id"])))
        doc, line, block = (np.asarray(group[c])[order] for c in ("doc_id", "line", "block"))
        codes = group["codes"].to_pylist()
        sets = [np.frombuffer(codes[k], np.uint64) for k in order.tolist()]
        size, at = np.array([len(s) for s in sets]), place_codes(doc, line)
        parity = [np.array(x, np.uint64) for x in zip(*[[np.bitwise_xor.reduce(b) for b in bits_of(s)] for s in sets])]
        one, gone = group["i"][0] == group["j"][0], []
        for y in range(1, len(sets)):
            x = np.flatnonzero((at[:y] < at[y]) & ((block[:y] != block[y]) | one))
            need = t / (1 + t) * (size[x] + size[y]) - 1e-9
            x = x[(np.minimum(size[x], size[y]) >= need) & (differing(parity, x, np.full(len(x), y)) <= size[x] + size[y] - 2 * need)]
            own = set(sets[y].tolist()) if len(x) else None
            if any(similar(set(sets[k].tolist()), own, t) for k in x.tolist()):
                gone.append(y)
        return pa.table({"doc_id": pa.array(doc[gone], pa.int64()), "line": pa.array(line[gone].astype(np.int32), pa.int32())})

    return check


def second_round(texts: DataFrame, words: DataFrame, t: float, least: int, levels: np.ndarray, buckets: int) -> DataFrame:
    """Places whose lines are like an earlier one with which they share one of these words (word, crowded)."""
    some, crowded = (Sieve(words.where(F.col("crowded") == c).select("word")).bits for c in (False, True))
    rows = stored(texts.mapInArrow(freeing(crowd_rows(t, least, levels, buckets, some, crowded)), CROWD_ROWS))
    blocks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    dealt = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "line"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "line", "codes")
    return sent.groupBy("key", "i", "j").applyInArrow(crowd_checker(t), "doc_id long, line int").distinct()


def removed_lines(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line of the lines that go."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = np.zeros(COUNTERS, np.int64)
    part = COUNTERS // 64
    for r in texts.mapInArrow(freeing(survey), "part int, block binary").repartition(64, "part").mapInArrow(freeing(tally), "part int, block binary").toLocalIterator():
        counts[r["part"] * part : (r["part"] + 1) * part] = unpack(r["block"], 1)[0]
    levels = np.minimum(255, np.round(8 * np.log2(counts + 1))).astype(np.uint8)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    buckets = max(ranges, int(counts.sum() * (1 - t)) // BUCKET_ROWS)
    blocks = texts.mapInArrow(freeing(packer(t, least, levels, buckets)), BLOCKS)
    # A task's blocks reach Python as one batch, so tasks are small.
    all_met = stored(blocks.repartition(TASKS * ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(freeing(sweeper(t, buckets)), MET))
    place = ["doc_id", "line"]
    pairs = all_met.where(F.col("kind") == MEETS)
    near = stored(pairs.select("doc_a", "line_a", *place).distinct())
    gone = stored(all_met.where(F.col("kind") == GOES).select(*place).union(verified(texts, near, t)).distinct())
    words = pairs.where("word >= 0").join(gone, place, "left_anti").select("word", F.lit(False).alias("crowded"))
    words = words.union(all_met.where(F.col("kind") == CROWDED).select("word", F.lit(True).alias("crowded")))
    words = stored(words.distinct())
    if words.isEmpty():
        return gone
    return stored(gone.union(second_round(texts, words, t, least, levels, buckets)).distinct())


def without_repeats(docs: DataFrame, t: float = SIMILARITY, least: int = LEAST_WORDS, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")) -> DataFrame:
    """docs, text without its removed lines, with two counts (long) under the names given: a text's
    lines (null: 0) and those removed.

    Lines are in order of doc_id and place.  Lines of fewer than `least` words stay.  Null texts stay
    null; rows without doc_id stay as they are and match nothing.  Rows that share a doc_id are one
    document: its k-th lines are one place and no repeats of each other, and go in all its rows as soon as
    one of them is like an earlier line.  Other columns may have any names; no rows give no rows.
    """
    name = fresh(docs.columns)
    gone = stored(removed_lines(docs, t, least).groupBy(F.col("doc_id").alias(name("id"))).agg(F.sort_array(F.collect_list("line")).alias(name("gone"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.split("text", "\n", -1)
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    # Only documents that may lose lines are moved, by the same plan whatever their number.
    touched = docs.withColumn(name("may"), F.coalesce(Sieve(gone.select(name("id"))).holds(F.col("doc_id").cast("long")) & F.col("doc_id").isNotNull(), F.lit(False)))
    places = F.filter(F.coalesce(name("gone"), F.array().cast("array<int>")), lambda k: k < F.size(lines))
    joined = touched.where(name("may")).join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(name("id")), "left").withColumn(name("n"), F.coalesce(F.size(places), F.lit(0)))
    keep = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(name("gone")))
    left = let(lines, lambda x: F.array_join(F.transform(keep(x), lambda k: F.get(x, k)), "\n"))
    text = F.when(F.col(name("n")) > 0, left).otherwise(F.col("text")).alias("text")
    with_counts = lambda n: [] if counts is None else [n_lines.alias(counts[0]), n.cast("long").alias(counts[1])]
    whole = touched.where(~F.col(name("may"))).select(*columns, *with_counts(F.lit(0)))
    cut = joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns], *with_counts(F.col(name("n"))))
    return whole.unionAll(cut)
