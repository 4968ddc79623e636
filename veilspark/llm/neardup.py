"""Near-duplicate documents by an LSH forest.

Each tree sorts the documents by its own sequence of min-hashes.  Rows that share a prefix of LEAST_DEPTH
hashes are a region.  All pairs of a small region are candidates; a crowded one is cut deeper, hash by
hash, until its parts are small, and its rows also meet the neighbours with the longest common prefixes.
Candidates are confirmed on their full shingle sets, so no link is wrong.  What a crowded region then
still holds apart is compared in full, block by block, so none is lost.  Documents with equal sets are
one class from the start, and orders are cut into ranges, so no group of copies lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, components, find, freeing, join_up, slices, stored
from .shingles import mix64, shingle_sets

#: Two documents of similarity 0.85 share no prefix of 4 in any of 24 trees once in 5e7 pairs.
TREES, LEAST_DEPTH = 24, 4
#: Hashes of a tree's sequence: so deep may crowded regions be cut.
DEPTH = 6
#: Rows of a region that are all paired, and the neighbours that a row of a crowded one meets at least.
CROWD, NEAREST = 12, 2
#: Rows, and shingles of them all, of a crowded region that are compared with as many others at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
#: Shingles of two blocks that are looked at together.
COLUMNS = 2048
#: How far below the threshold an estimate may lie for a pair to be confirmed: over 6 standard errors
#: (at 0.85 that loses a pair in less than 1e-8).
SLACK = 0.25


def trees_for(percent: int) -> int:
    """Trees that miss a pair of this similarity no more often than TREES do at 0.85."""
    return max(TREES, math.ceil(math.log(2.1e-8) / math.log(1 - (percent / 100) ** LEAST_DEPTH)))


def signer(length: int, trees: int = TREES):
    n = trees * DEPTH
    rng = np.random.default_rng(20240601)
    mul = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, n, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, digest, sig = [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), length):
                size.append(len(s))
                if not len(s):
                    digest.append(None)
                    sig.append(None)
                    continue
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                h = (s >> np.uint64(32)).astype(np.uint32)
                low = np.full(n, np.iinfo(np.uint32).max, np.uint32)
                for at in range(0, len(h), 1024):
                    np.minimum(low, (h[at : at + 1024, None] * mul + add).min(axis=0), out=low)
                sig.append(low.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return sign


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, sig -> a row for each tree: its first hashes as one key, and the next ones."""
    for b in slices(batches, 4096):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1, DEPTH).astype(np.uint64)
        key = np.broadcast_to(np.arange(sig.shape[1], dtype=np.uint64), sig.shape[:2])
        for k in range(LEAST_DEPTH):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
        deep = (sig[:, :, LEAST_DEPTH] << np.uint64(32)) | sig[:, :, LEAST_DEPTH + 1]
        ids = np.repeat(np.asarray(b.column(0)), sig.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(deep.view(np.int64).ravel()), pa.array(ids)], names=["key", "deep", "id"])


FOUND = "kind int, key long, id long, other long"
#: What a row of FOUND is: a candidate pair, or the key of a region in which not all pairs were met.
PAIR, REGION = 0, 1


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> FOUND.  The regions at both ends of this range may go on beside it."""
    held = [np.empty(0, np.int64)] * 3
    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns)]
        first, last = columns[0][0] if first is None else first, columns[0][-1]
        # The last region waits for the rest of it, unless it is long: then it is cut here, as crowded.
        tail = len(columns[0]) - int((columns[0] == last).sum())
        if len(columns[0]) - tail > 20_000:
            yield found(REGION, [last])
            tail = len(columns[0])
        held = [c[tail:] for c in columns]
        yield from met(*[c[:tail] for c in columns])
    yield from met(*held)
    if first is not None:
        yield found(REGION, sorted({first, last}))


def met(key: np.ndarray, deep: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of whole regions, in order -> FOUND."""
    n = len(key)
    if not n:
        return
    part = [np.ones(n, bool) for _ in range(3)]  # where a region begins, at each depth
    part[0][1:] = key[1:] != key[:-1]
    part[1][1:] = part[0][1:] | ((deep[1:] >> 32) != (deep[:-1] >> 32))
    part[2][1:] = part[0][1:] | (deep[1:] != deep[:-1])
    label = [np.cumsum(p) for p in part]
    small = [np.bincount(x)[x] <= CROWD for x in label]
    pairs, j = [], np.arange(n)
    for d in range(1, CROWD):
        j = j[j >= d]
        j = j[label[0][j] == label[0][j - d]]
        use = np.full(len(j), d <= NEAREST)
        for x, s in zip(label, small):
            use |= s[j] & (x[j] == x[j - d])
        pairs.append((j[use], j[use] - d))
    crowded = np.flatnonzero(~small[0])
    start = np.maximum.accumulate(np.where(part[0], np.arange(n), 0))
    pairs.append((crowded, start[crowded]))
    x, y = (ids[np.concatenate(p)] for p in zip(*pairs))
    high, low = np.maximum(x, y), np.minimum(x, y)
    yield found(PAIR, np.zeros(int((x != y).sum()), np.int64), high[x != y], low[x != y])
    yield found(REGION, np.unique(key[crowded]))


def found(kind: int, key, ids=None, other=None) -> pa.RecordBatch:
    none = np.zeros(len(key), np.int64)
    arrays = [np.full(len(key), kind, np.int32), np.asarray(key, np.int64), none if ids is None else ids, none if other is None else other]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[c.split()[0] for c in FOUND.split(", ")])


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, sig_a, sig_b -> a, b, share of equal min-hashes."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(b.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).mean(axis=1))], names=["a", "b", "likely"])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmer(length: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, text_a, text_b -> u, v of those similar enough on their full sets."""
        for b in slices(batches, 256):
            x, y, tx, ty = (c.to_pylist() for c in b.columns)
            texts = list(dict.fromkeys([*tx, *ty]))
            sets = dict(zip(texts, shingle_sets(texts, length)))
            got = [(p, q) for p, q, s, t in zip(x, y, tx, ty) if alike(sets[s], sets[t], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["u", "v"])

    return confirm


def shared(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of these sets shares with each of the others."""
    both = [*sets, *others]
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    wanted = np.cumsum(n > 1) - 1  # what one set alone holds is shared with none
    row, column = row[n[column] > 1], wanted[column[n[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(others)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(both), COLUMNS), np.float32)
        table[row[a:b], column[a:b] - at] = 1
        out += table[: len(sets)] @ table[len(sets) :].T
    return out


def crowd_confirmer(percent: int):
    def confirm(group: pa.Table) -> pa.Table:
        """Rows of two blocks of a region, with their sets -> u, v: links enough to join what they join."""
        ids, root = np.asarray(group["id"]), np.asarray(group["root"])
        side = np.asarray(group["side"])
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(y):  # a block with itself
            y = x
        if not len(x):
            x = y
        size = np.array([len(s) for s in sets], np.int64)
        both = shared([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
        hits = np.argwhere((100 * both >= percent * (size[x][:, None] + size[y][None] - both)) & (root[x][:, None] != root[y][None]))
        parent: dict[int, int] = {}
        got = [(int(ids[x[i]]), int(ids[y[j]])) for i, j in hits.tolist() if join_up(parent, int(root[x[i]]), int(root[y[j]]))]
        return pa.table({"u": pa.array([g[0] for g in got], pa.int64()), "v": pa.array([g[1] for g in got], pa.int64())})

    return confirm


def crowd_links(crowd: DataFrame, sizes: DataFrame, joined: DataFrame, sets_of, percent: int) -> DataFrame:
    """crowd (key, id) and sizes (id, size of its set): the rows of crowded regions -> u, v between the components (joined) that a region
    holds.  Every pair in different ones meets.  A region's largest component is its main one: blocks
    of it meet blocks of the others, and blocks of the others meet each other."""
    rows = stored(crowd.join(joined.select(F.col("node").alias("id"), "root"), "id", "left").join(sizes, "id").select("key", "id", F.coalesce("root", "id").alias("root"), "size"))
    by_root = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    split = by_root.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > main.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("long")
    others = blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    split = split.select("key", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"), others.alias("others"))
    dealt = rows.join(split, "key").withColumn("is_main", F.col("root") == F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    meets = lambda main, i, j, side: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    own = F.col("block")
    with_main = F.transform(upto(F.col("mains")), lambda i: meets(True, i, own, 1))
    each_other = F.transform(upto(F.col("others")), lambda j: meets(False, F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1)))
    to = F.when(F.col("is_main"), F.transform(upto(F.col("others")), lambda j: meets(True, own, j, 0))).otherwise(F.concat(with_main, each_other))
    sent = dealt.withColumn("block", block).select("key", "id", "root", F.explode(to).alias("to")).select("key", "to.*", "id", "root")
    full = sent.join(sets_of(sent.select("id").distinct()), "id")
    return full.groupBy("key", "main", "i", "j").applyInArrow(crowd_confirmer(percent), "u long, v long")


def classes_of(signed: DataFrame) -> DataFrame:
    """digest -> rep (smallest doc_id with that set), its signature and the size of the set."""
    return signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.sig").alias("sig"), F.col("m.n_shingles").alias("size"))


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """a > b with their estimated similarity, for pairs that may be similar enough; and key, id of the
    regions in which not all pairs were met: crowded ones, and those at the ends of ranges."""
    spark = classes.sparkSession
    rows = stored(classes.select("rep", "sig").mapInArrow(freeing(prefixes), "key long, deep long, id long"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    order = ["key", "deep", "id"]
    swept = stored(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(freeing(neighbours), FOUND).distinct())
    pairs = swept.where(F.col("kind") == PAIR).select(F.col("id").alias("a"), F.col("other").alias("b"))
    sigs = classes.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    crowd = rows.join(swept.where(F.col("kind") == REGION).select("key").distinct(), "key", "left_semi").select("key", "id")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(freeing(agreeing), "a long, b long, likely double").where(F.col("likely") >= percent / 100 - SLACK), crowd


def near_duplicates(docs: DataFrame, length: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links join documents with 100 * intersection >= percent * union of their shingle sets.
    Documents without words or text have an empty set, link with nothing and are kept, as are rows
    without doc_id.  Rows that share a doc_id are one document, which has the links of all of them.
    Other columns may have any names; no rows give no rows.  A component is confirmed step by step:
    first each class with its likeliest partner, then only pairs between different components, then
    what crowded regions still hold apart.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(docs.mapInArrow(freeing(signer(length, trees_for(percent))), "doc_id long, n_shingles long, digest binary, sig binary"))
    classes = stored(classes_of(signed))
    pairs, crowd = map(stored, candidates(classes, percent))
    # Documents whose rows have different sets join their classes.
    several = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("doc_id")
    several = stored(signed.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct())

    def texts_of(wanted: DataFrame) -> DataFrame:
        # Hardly any texts but the wanted ones are moved.
        wanted = wanted.toDF("a")
        some = docs.select(F.col("doc_id").alias("a"), "text").where(Sieve(wanted).holds(F.col("a")))
        return some.join(wanted, "a", "left_semi")

    def sets_of(wanted: DataFrame) -> DataFrame:
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                found = [s.tobytes() for s in shingle_sets(b.column(1).to_pylist(), length)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

        return stored(texts_of(wanted).mapInArrow(freeing(sets), "id long, shingles binary").where("octet_length(shingles) > 0"))

    texts = stored(texts_of(pairs.select("a").union(pairs.select("b")).distinct()).dropDuplicates(["a", "text"]))

    def confirmed(some: DataFrame) -> DataFrame:
        full = some.select("a", "b").join(texts.withColumnRenamed("text", "text_a"), "a").join(texts.select(F.col("a").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(full.select("a", "b", "text_a", "text_b").mapInArrow(freeing(confirmer(length, percent)), "u long, v long"))

    first = confirmed(pairs.groupBy("a").agg(F.max(F.struct("likely", "b")).alias("m")).select("a", F.col("m.b").alias("b"))).union(several)
    joined = components(first)
    root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = confirmed(apart)
    joined = components(first.union(more))
    rest = stored(crowd_links(crowd, classes.groupBy(F.col("rep").alias("id")).agg(F.max("size").alias("size")), joined, sets_of, percent))
    if not rest.isEmpty():
        joined = components(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest))
    found = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
