import hashlib

from pyspark.sql import functions as F

from veilspark.functions.text import pattern_of
from veilspark.operators import links
from veilspark.plans import report
from veilspark.sources import files
from veilspark.streaming import residual


def test_snapshot_is_hashlib_s(spark):
    rows = [("e", "b.htm", b"x"), ("e", "a/ä.pdf", b""), ("f", "a", b"\x00\xff")]
    got = {r.event_id: r.snapshot for r in files.snapshot(spark.createDataFrame(rows, "event_id string, rel string, content binary")).collect()}
    for event in "ef":
        h = hashlib.sha256()
        for _, rel, data in sorted(r for r in rows if r[0] == event):
            h.update(rel.encode() + b"\0" + hashlib.sha256(data).digest())
        assert got[event] == h.hexdigest()


def test_mirror_and_limits(spark, tmp_path):
    for rel in ("e1/index.htm", "e1/sub/a.pdf", "e2/x.css"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    got = files.read_mirror(spark, str(tmp_path))
    assert sorted((r.event_id, r.rel) for r in got.collect()) == [("e1", "index.htm"), ("e1", "sub/a.pdf"), ("e2", "x.css")]
    stats = {r.event_id: r for r in files.scan_stats(got.withColumn("scope", F.lit("dir"))).collect()}
    assert stats["e1"].files == 2 and stats["e1"].html == 1 and stats["e1"].pdf == 1
    assert {r.error for r in files.limit_error(got).collect()} == {None}
    many = spark.range(801).select(F.lit("e").alias("event_id"), F.col("id").cast("string").alias("rel"), F.lit(b"").alias("content"))
    assert files.limit_error(many).first().error == "too_many_files"


def test_reachability_stops_at_cycles_and_leaves(spark):
    rows = [("e", "i.htm", "a.htm"), ("e", "a.htm", "i.htm"), ("e", "a.htm", "b.pdf"), ("e", "b.pdf", "c.htm"), ("e", "a.htm", "d.zip"), ("e", "z.htm", "y.htm"), ("f", "i.htm", "q.htm")]
    links_ = spark.createDataFrame(rows, "event_id string, rel string, target string")
    got = files.reachable(links_, spark.createDataFrame([("e", "i.htm")], "event_id string, rel string"))
    assert sorted(r.rel for r in got.collect()) == ["a.htm", "b.pdf", "i.htm"]
    there = spark.createDataFrame([("e", "i.htm"), ("e", "a.htm")], "event_id string, rel string")
    assert [r.rel for r in files.missing(got, there).collect()] == ["b.pdf"]


def test_safe_paths_and_protocols(spark):
    rel = spark.createDataFrame([("a/b",), ("../x",), ("/x",), ("a/../b",), ("",)], "r string")
    assert [r[0] for r in rel.select(files.safe_path(F.col("r"))).collect()] == [True, False, False, False, False]
    pdf = spark.createDataFrame([("http://h/a.PDF?x", b"%PDF-1"), ("http://h/a.pdf", b"<html"), ("http://h/a", b"%PDF")], "u string, c binary")
    assert [r[0] for r in pdf.select(links.is_protocol(F.col("u"), F.col("c"))).collect()] == [True, False, False]
    out = spark.createDataFrame([("http://h/e/", "http://H/e/p/a%20b.pdf"), ("http://h/e/", "http://h/E/x.pdf"), (None, "http://o/y.pdf")], "b string, u string")
    assert [r[0] for r in out.select(links.protocol_path(F.col("b"), F.col("u"))).collect()] == ["p/a b.pdf", "x.pdf", "y.pdf"]


def test_archive_refuses_names(spark):
    import io
    import zipfile

    import pytest

    changed = spark.createDataFrame([("e", "b.htm", b"2"), ("e", "a.htm", b"1"), ("f", "c", b"3")], "event_id string, rel string, content binary")
    made = zipfile.ZipFile(io.BytesIO(report.archive(changed, "e", "{}", ["Liisa Kärki"])))
    assert made.namelist() == [report.MANIFEST, "a.htm", "b.htm"] and made.read("a.htm") == b"1"
    with pytest.raises(ValueError):
        report.archive(changed, "e", '{"x": "k&#xE4;rki, LIISA"}', ["Liisa Kärki"])


def test_stream_of_pages(spark, tmp_path):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")
    rows = [("e", "a.htm", "x\nLiisa Kärki".encode()), ("e", "b.htm", b"nobody")]
    spark.createDataFrame(rows, "event_id string, rel string, content binary").write.parquet(pages)
    patterns = spark.createDataFrame([("e", 0, pattern_of("Liisa Kärki"))], "event_id string, name_idx int, pattern string")
    stream = spark.readStream.schema("event_id string, rel string, content binary").parquet(pages)
    residual.watch(stream, patterns, out, str(tmp_path / "state")).awaitTermination()
    assert [(r.rel, r.location) for r in spark.read.parquet(out).collect()] == [("a.htm", "line 2")]
