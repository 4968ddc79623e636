"""Tables kept between steps, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import shared_folder, stored  # noqa: F401


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows: it bounds what a worker holds as objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def release() -> None:
    """Gives memory that this process has freed back to the system, as far as its allocators allow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def freeing(run: Callable) -> Callable:
    """A function of batches whose worker gives back what it has freed once a task is done: idle workers stay
    for a minute, beside those of the stages after theirs."""

    def and_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return and_free


def fresh(columns: list[str]) -> Callable[[str], str]:
    """Names for columns of our own that none of these have (in any case)."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return lambda name: mark + name


def find(parent: dict, x):
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def join_up(parent: dict, a, b) -> bool:
    """Joins two trees under the smaller root; false if they were one."""
    a, b = find(parent, a), find(parent, b)
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    parent.setdefault(min(a, b), min(a, b))
    return True


#: Links that a task contracts at a time; it bounds the task's memory.
CONTRACT_ROWS = 200_000


def contract(links: DataFrame) -> DataFrame:
    """The same components from fewer links: each run of links becomes a forest of stars."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            pairs = [(x, find(parent, x)) for x in list(parent)]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                join_up(parent, u, v)
            if len(parent) > CONTRACT_ROWS:
                yield out()
                parent.clear()
        yield out()

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(freeing(forest), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """links (u, v long) -> node, root: the smallest node reachable, for every node with a link.

    Alternating large-star and small-star steps until nothing changes; each step is a grouped
    minimum (pre-aggregated) and a plain join that Spark can split at hot nodes.  Between rounds
    the links lie in the shared folder.
    """
    now = stored(contract(contract(links)).where("u <> v").distinct())
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # One link for each node, all to roots, is a star forest; so is a state that repeats.
        if state == before or (state[0] == state[1] and now.select("v").join(now.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty()):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


#: Bits of a sieve: 4 MB whatever the number of ids.
SIEVE_BITS = 1 << 25
SIEVE_PARTS = 64


class Sieve:
    """A bitmap of hashed ids of a fixed size.  It lets all of its ids through, and hardly any others
    while they are fewer than its bits; beyond that it only filters less."""

    def __init__(self, ids: DataFrame):
        """ids: one column, long.  Tasks fill bitmaps, parts of which are joined before they come."""
        width = SIEVE_BITS // SIEVE_PARTS // 8

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                at = slots(np.asarray(b.column(0)))
                for part in np.unique(at // (width * 8)).tolist():
                    bits = held.setdefault(part, np.zeros(width * 8, bool))
                    bits[at[at // (width * 8) == part] % (width * 8)] = True
            yield out({k: np.packbits(v) for k, v in held.items()})

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    new = np.frombuffer(bits, np.uint8)
                    held[part] = held[part] | new if part in held else new
            yield out(held)

        def out(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"])

        kind = "part int, bits binary"
        self.bits = np.zeros(SIEVE_BITS // 8, np.uint8)
        for r in ids.mapInArrow(freeing(fill), kind).repartition(SIEVE_PARTS, "part").mapInArrow(freeing(merge), kind).toLocalIterator():
            self.bits[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)

    def holds(self, column: Column) -> Column:
        bits = self.bits

        @F.pandas_udf("boolean")
        def held(ids: pd.Series) -> pd.Series:
            at = slots(ids.fillna(0).to_numpy(np.int64))
            return pd.Series((bits[at // 8] >> (7 - at % 8)) & 1 == 1)

        return held(column)


def slots(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(SIEVE_BITS)).astype(np.int64)
