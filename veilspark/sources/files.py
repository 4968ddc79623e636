"""Files of events: reading mirrored folders, reachability, hashes and counts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import FOLLOWED, SCANNED, classify_link, extract_links

#: Limits of an event, as errors rather than cuts.
MOST_FILES, MOST_FILE_BYTES, MOST_TOTAL_BYTES = 800, 60 << 20, 400 << 20


def read_mirror(spark: SparkSession, root: str) -> DataFrame:
    """event_id, rel, content of a folder that holds one folder for each event."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(F.regexp_extract(tail, "^([^/]+)/", 1).alias("event_id"), checked_path(F.regexp_replace(tail, "^[^/]+/", "")).alias("rel"), "content")


def safe_path(rel: Column) -> Column:
    """Whether a path stays inside its folder."""
    return (rel != "") & ~rel.startswith("/") & ~F.array_contains(F.split(rel, "/"), "..")


def checked_path(rel: Column) -> Column:
    """The path; one that leaves its folder is an error."""
    return F.when(safe_path(rel), rel).otherwise(F.raise_error(F.lit("unsafe_path")).cast("string"))


def checkpoints(spark: SparkSession) -> None:
    """Sees that there is a folder for checkpoints: the one in spark.checkpoint.dir, or, where all runs on
    one machine and none is set, one of our own."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() is not None:
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "veilspark-checkpoints"))


def links_of(pages: DataFrame) -> DataFrame:
    """event_id, rel, base_url, text -> every link with its kind and target."""
    found = extract_links(pages.withColumn("page_url", F.concat("base_url", "rel")))
    return found.withColumn("_to", classify_link(F.col("base_url"), F.col("page_url"), F.col("value"))).select("*", "_to.kind", "_to.target").drop("_to")


def reachable(links: DataFrame, roots: DataFrame, most_rounds: int = MOST_FILES) -> DataFrame:
    """event_id, rel reachable from roots (event_id, rel) over links (event_id, rel, target) to
    followed files; only re-scanned files lead on.  A round adds a frontier; a file is met once.

    A round's visited set is cut from its lineage in the folder of spark.checkpoint.dir.  An event that
    is not done after most_rounds rounds is an error.
    """
    checkpoints(links.sparkSession)
    like = lambda c, ends: F.exists(F.array(*[F.lit(e) for e in ends]), lambda e: F.lower(c).endswith(e))
    edges = links.where(like(F.col("target"), FOLLOWED) & like(F.col("rel"), SCANNED)).select("event_id", "rel", "target").distinct()
    seen = roots.select("event_id", "rel").distinct()
    frontier = seen
    for _ in range(most_rounds):
        new = edges.join(frontier, ["event_id", "rel"]).select("event_id", F.col("target").alias("rel")).distinct()
        frontier = new.join(seen, ["event_id", "rel"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    else:
        raise ValueError("too_many_files")
    return seen


def missing(reached: DataFrame, files: DataFrame) -> DataFrame:
    """Linked files that are not there."""
    return reached.join(files.select("event_id", "rel"), ["event_id", "rel"], "left_anti")


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def snapshot(files: DataFrame) -> DataFrame:
    """event_id, snapshot: hash over the sorted paths, each with a zero byte and its file's raw digest."""
    entry = F.struct("rel", F.unhex(file_digest(F.col("content"))).alias("digest"))
    add = lambda a, f: F.concat(a, F.encode(f["rel"], "UTF-8"), F.lit(b"\x00"), f["digest"])
    whole = F.aggregate(F.array_sort(F.collect_list(entry)), F.lit(b""), add)
    return files.groupBy("event_id").agg(F.sha2(whole, 256).alias("snapshot"))


def scan_stats(files: DataFrame) -> DataFrame:
    """Counts of files by event; scope tells dir, shared and missing files apart."""
    low, own = F.lower("rel"), F.col("scope") == "dir"
    return files.groupBy("event_id").agg(
        F.count_if(own).alias("files"), F.count_if(own & low.rlike(r"\.html?$")).alias("html"), F.count_if(own & low.endswith(".pdf")).alias("pdf"),
        F.count_if(F.col("scope") == "shared").alias("shared_assets"), F.count_if(F.col("scope") == "missing").alias("missing_links"),
    )


def limit_error(files: DataFrame) -> DataFrame:
    """event_id, error: too_many_files, file_too_large, event_too_large, or null."""
    size = F.length("content")
    return files.groupBy("event_id").agg(
        F.when(F.count(F.lit(1)) > MOST_FILES, F.lit("too_many_files")).when(F.max(size) > MOST_FILE_BYTES, F.lit("file_too_large")).when(F.sum(size) > MOST_TOTAL_BYTES, F.lit("event_too_large")).alias("error")
    )
