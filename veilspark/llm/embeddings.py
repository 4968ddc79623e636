"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors of cosine >= c lie within eps = sqrt(2 - 2c) of each other.  Rotated to principal
dimensions they are sorted by their grid cells of width eps, leading dimension first, and cut into
intervals.  Pairs of intervals are refined from the whole sequence downwards: pairs whose boxes are
further apart than eps are skipped with all they hold.  What is left is compared in blocks; a block
gives each vector's number of links and a spanning forest, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, find, join_up, stored

#: Leading dimensions of the grid, vectors of an interval (sent whole) and of a block within it,
#: and how many intervals make the next larger one.
GRID, INTERVAL, BLOCK, FANOUT = 16, 4096, 256, 8


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    big = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def packer(kind: type):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, vector -> vec_id, raw bytes, digest, number of components."""
        for b in batches:
            raw = [np.asarray(v, kind) for v in b.column(1).to_pylist()]
            raw = [np.where(v == 0, kind(0), v).tobytes() for v in raw]  # no negative zero
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array([len(r) // kind().itemsize for r in raw], pa.int32())],
                names=["vec_id", "raw", "digest", "dims"],
            )

    return pack


def units(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotation(vectors: DataFrame, kind: type, dims: int) -> np.ndarray:
    """Principal directions of all vectors, the widest first: sums over all rows, of which dims
    squared come to the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, one, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for b in batches:
            if b.num_rows:
                x = units(b.column(0).to_pylist(), kind)
                total, one, n = total + x.T @ x, one + x.sum(axis=0), n + len(x)
        flat = np.concatenate([total.ravel(), one, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    sums = vectors.select("raw").mapInArrow(moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(dims * dims + dims + 1)
    for r in sums:
        flat[r["at"]] = r["x"]
    n, mean = max(flat[-1], 1.0), flat[dims * dims : -1] / max(flat[-1], 1.0)
    spread = flat[: dims * dims].reshape(dims, dims) / n - np.outer(mean, mean)
    return np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1])


def boxes(prefix: str, g: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(g)]


def intervals(vectors: DataFrame, kind: type, turn: np.ndarray, eps: float) -> DataFrame:
    """Sorted vectors as intervals: range, number, packed members and the box of their leading dimensions."""
    g = min(GRID, turn.shape[0])
    lead = turn[:, :g]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.floor(units(b.column(1).to_pylist(), kind) @ lead / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.tolist(), pa.list_(pa.int32()))], names=["rep", "raw", "weight", "cell"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out(t: pa.Table, number: int) -> pa.RecordBatch:
            raw = t.column("raw").to_pylist()
            y = units(raw, kind) @ lead
            columns = [pa.array([here], pa.int32()), pa.array([number], pa.int32()), pa.array([t.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([t.column("weight").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([b"".join(raw)], pa.binary())]
            columns += [pa.array([v]) for v in (*y.min(axis=0), *y.max(axis=0))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "number", "ids", "weights", "raw", *boxes("lo", g), *boxes("hi", g)])

        for b in batches:
            held.append(b)
            size += b.num_rows
            while size >= INTERVAL:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, INTERVAL), number)
                rest = t.slice(INTERVAL)
                held, size, number = rest.to_batches(), rest.num_rows, number + 1
        if size:
            yield out(pa.Table.from_batches(held), number)

    n = vectors.count()
    ranges = max(1, -(-n // INTERVAL))
    schema = "part int, number int, ids binary, weights binary, raw binary, " + ", ".join(f"{c} double" for c in boxes("lo", g) + boxes("hi", g))
    sorted_ = stored(vectors.select("rep", "raw", "weight").mapInArrow(cells, "rep long, raw binary, weight long, cell array<int>"))
    return sorted_.repartitionByRange(ranges, "cell", "rep").sortWithinPartitions("cell", "rep").mapInArrow(pack, schema)


def near_boxes(g: int, eps: float) -> Column:
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"))
    total = F.lit(0.0)
    for k in range(g):
        total = total + gap(k) * gap(k)
    return total <= eps * eps * (1 + 1e-9) + 1e-9


def interval_pairs(leaves: DataFrame, g: int, eps: float, parts: int) -> DataFrame:
    """Pairs of intervals (a_id <= b_id) that may hold near vectors.  The tree above them groups
    neighbours in the order FANOUT by FANOUT; a pair of nodes opens into pairs of their children."""
    lo, hi = boxes("lo", g), boxes("hi", g)
    node_id = F.col("part").cast("long") * (1 << 24) + F.col("number")
    leaf = leaves.select(node_id.alias("id"), F.col("part").cast("long").alias("up"), *lo, *hi)

    def merged(level: DataFrame, up: Column) -> DataFrame:
        own = level.groupBy(F.col("up").alias("id")).agg(*[F.min(c).alias(c) for c in lo], *[F.max(c).alias(c) for c in hi])
        return own.withColumn("up", up)

    levels, span = [leaf], parts
    while span > 1:
        levels.append(merged(levels[-1], F.floor(F.col("id") / FANOUT).cast("long")))
        span = -(-span // FANOUT)
    levels.append(merged(levels[-1], F.lit(0).cast("long")))
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.col("id").alias(f"{s}_id"), F.col("up").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in lo + hi])  # noqa: B023, E731
        opened = pairs.join(side("a"), "a").join(side("b"), "b")
        pairs = opened.where((F.col("a_id") <= F.col("b_id")) & near_boxes(g, eps)).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs


def links_in(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether each pair's cosine reaches the bound: single precision, and doubles where that is too close to tell."""
    s = x.astype(np.float32) @ y.astype(np.float32).T
    hit = s >= cosine
    i, j = np.nonzero(np.abs(s - cosine) < 1e-4)
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        hit[p, q] = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
    return hit


def comparer(kind: type, turn: np.ndarray, cosine: float):
    lead = turn[:, : min(GRID, turn.shape[0])]
    eps2 = (2 - 2 * cosine) * (1 + 1e-9) + 1e-9

    def blocks(y: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        return [(at, min(at + BLOCK, len(y)), y[at : at + BLOCK].min(axis=0), y[at : at + BLOCK].max(axis=0)) for at in range(0, len(y), BLOCK)]

    def opened(raw: bytes, n: int) -> np.ndarray:
        size = len(raw) // n
        return units([raw[k * size : (k + 1) * size] for k in range(n)], kind)

    def forest(parent: dict, hit: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> None:
        rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        sub = hit[np.ix_(rows, cols)]
        if sub.sum() <= 4 * (len(rows) + len(cols)):
            for i, j in zip(*(k.tolist() for k in np.nonzero(sub))):
                join_up(parent, int(ids_x[rows[i]]), int(ids_y[cols[j]]))
            return
        # Many links: the smallest label spreads along rows and columns until it rests.
        top = np.iinfo(np.int64).max
        a, b = ids_x[rows].copy(), ids_y[cols].copy()
        while True:
            new_a = np.minimum(a, np.where(sub, b[None, :], top).min(axis=1))
            new_b = np.minimum(b, np.where(sub, new_a[:, None], top).min(axis=0))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
        for node, label in ((ids_x[rows], a), (ids_y[cols], b)):
            for n, r in zip(node.tolist(), label.tolist()):
                join_up(parent, n, r)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of packed intervals -> id, links found here, and its root in this pair's forest."""
        for batch in batches:
            for a, b, ids_a, w_a, raw_a, ids_b, w_b, raw_b in zip(*[c.to_pylist() for c in batch.columns]):
                ia, wa, ib, wb = (np.frombuffer(v, np.int64) for v in (ids_a, w_a, ids_b, w_b))
                x = opened(raw_a, len(ia))
                y = x if a == b else opened(raw_b, len(ib))
                na, nb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                parent: dict[int, int] = {}
                bx, by = blocks(x @ lead), blocks(y @ lead)
                for p, (s0, s1, lo, hi) in enumerate(bx):
                    for q, (t0, t1, lo2, hi2) in enumerate(by):
                        if a == b and q < p:
                            continue
                        gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
                        if gap @ gap > eps2:
                            continue
                        hit = links_in(x[s0:s1], y[t0:t1], cosine)
                        if a == b and p == q:
                            np.fill_diagonal(hit, False)
                        if not hit.any():
                            continue
                        na[s0:s1] += hit @ wb[t0:t1]
                        if not (a == b and p == q):
                            nb[t0:t1] += wa[s0:s1] @ hit
                        forest(parent, hit, ia[s0:s1], ib[t0:t1])
                for ids, n in ((ia, na), (ib, nb)):
                    at = np.flatnonzero(n)
                    if len(at):
                        roots = [find(parent, k) for k in ids[at].tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(roots, pa.int64())], names=["id", "n", "root"])

    return compare


def near_vectors(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding.

    Vectors that are null, zero or hold null or non-finite components link with nothing, as do rows
    without vec_id and vectors of different lengths.  Equal vectors are one class that counts each
    of them; rows that share a vec_id share a component.  Other columns are not looked at.
    """
    spark = table.sparkSession
    inner = table.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if inner == "float" else np.float64
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>"))
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    packed = stored(rows.where(good).mapInArrow(packer(kind), "vec_id long, raw binary, digest binary, dims int"))
    classes = stored(packed.groupBy("dims", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("raw").alias("raw")))
    eps = float(np.sqrt(2 - 2 * cosine))
    found = spark.createDataFrame([], "id long, n long, root long")
    for (dims,) in classes.select("dims").distinct().orderBy("dims").collect():
        vectors = classes.where(F.col("dims") == dims)
        turn = rotation(vectors, kind, dims)
        leaves = stored(intervals(vectors, kind, turn, eps))
        parts = leaves.agg(F.max("part")).first()[0] + 1
        pairs = interval_pairs(leaves, min(GRID, dims), eps, parts)
        body = leaves.select((F.col("part").cast("long") * (1 << 24) + F.col("number")).alias("id"), "ids", "weights", "raw")
        side = lambda s: body.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "raw")])  # noqa: B023, E731
        # Pairs are dealt evenly before the vectors join them; an interval is at most INTERVAL vectors.
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ids_a", "weights_a", "raw_a", "ids_b", "weights_b", "raw_b")
        found = found.union(full.mapInArrow(comparer(kind, turn, cosine), "id long, n long, root long"))
    found = stored(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    told = (
        classes.select("digest", "dims", "rep", "weight")
        .join(counts, F.col("rep") == F.col("id"), "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("digest", "dims", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = packed.select("vec_id", "digest", "dims").join(told, ["digest", "dims"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
