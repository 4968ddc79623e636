"""URL filters as a sort-merge range join.

A host is keyed by its reversed labels, so that a rule's host and all its subdomains are one
interval of keys.  Rules and urls are dealt into key ranges, sorted, and swept once: the stack
holds the rules whose intervals are open, inner ones on top.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a key range, and the range count's bounds.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 100_000, 64, 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where there is no ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    rules: host, path, verdict.  A rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest host with path wins, then the later string.  Null urls and urls
    without :// have an empty host and path, and no rule.  Repeated rows stay; no pages give no rows.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    # What follows the key in a range's bounds only deals rows with one hot key to several ranges.
    place = F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.lower(F.hex(F.xxhash64("row"))))
    urls = urls.withColumn("place", place)
    n = pages.count()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_A_RANGE))
    some = urls.select("place").sample(min(1.0, 40 * ranges / max(n, 1)), seed=7).toPandas()["place"].sort_values().tolist()
    bounds = [some[i * len(some) // ranges] for i in range(1, ranges)] if some else []

    @F.pandas_udf("int")
    def range_of(places):
        return places.map(lambda p: bisect.bisect_right(bounds, p)).astype("int32")

    key = host_key(F.lower("host"))
    opened = rules.select(F.lower("host").alias("host"), "path", "verdict", key.alias("key"))
    # The interval of a rule's keys: from its own to the first that does not start with it.
    opened = opened.withColumn("first", range_of("key")).withColumn("end", range_of(F.concat("key", F.lit("\U0010ffff"))))
    opened = opened.select(F.explode(F.sequence("first", "end")).alias("bucket"), "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["row"].dataType).alias("row"), "host", "path", "verdict")
    swept = (
        urls.select(range_of("place").alias("bucket"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("verdict"))
        .unionByName(opened)
        .repartition(ranges, "bucket")
        .sortWithinPartitions("bucket", "key", "kind")
    )
    rows = pages.select(*[F.col(f"`{c}`") for c in own]).schema
    out = rows.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str]]] = []
        now = None
        for b in batches:
            keep, found, said = [], [], []
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bucket", "key", "kind", "host", "path", "verdict")]
            for i, (bucket, k, kind, h, p, v) in enumerate(zip(*columns)):
                if bucket != now:
                    stack, now = [], bucket
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, h, {}))
                    stack[-1][2][p] = v
                    continue
                best = None
                for _, rule_host, paths in stack if k else ():
                    for m in {len(x) for x in paths}:
                        if p[:m] in paths and len(p) >= m and (best is None or (len(rule_host) + m, rule_host + p[:m]) > best[:2]):
                            best = (len(rule_host) + m, rule_host + p[:m], paths[p[:m]])
                keep.append(i)
                found.append(best and best[1])
                said.append(best[2] if best else default)
            if keep:
                taken = b.take(pa.array(keep, pa.int64()))
                row = taken.column(taken.schema.get_field_index("row"))
                yield pa.RecordBatch.from_arrays(
                    [*row.flatten(), taken.column(taken.schema.get_field_index("host")), taken.column(taken.schema.get_field_index("path")), pa.array(found, pa.string()), pa.array(said, pa.string())],
                    names=[f.name for f in out],
                )

    return swept.mapInArrow(sweep, out)
