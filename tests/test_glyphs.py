from pyspark.sql import functions as F

from veilspark.functions.text import pattern_of
from veilspark.operators import glyphs, verify
from veilspark.plans import protocol

SCHEMA = "rel string, page int, line_no int, glyph_no int, c string, x0 double, y0 double, x1 double, y1 double, ox double, oy double, size double, bold boolean"


def line(page, line_no, text, x, y):
    return [("p.pdf", page, line_no, k, c, x + 6.0 * k, y - 9.0, x + 6.0 * k + 6, y + 2.0, x + 6.0 * k, float(y), 10.0, False) for k, c in enumerate(text)]


def pages(spark):
    rows = line(0, 0, "PODIUM", 50, 50) + line(0, 1, "Liisa Kärki", 50, 80)
    rows += line(1, 0, "Cup", 50, 20) + line(1, 1, "Results", 50, 40) + line(1, 2, "1 KÄRKI Liisa", 50, 80) + line(1, 3, "SUO", 200, 80.5) + line(1, 4, "9.50", 260, 80) + line(1, 5, "Matti Virta", 50, 100) + line(1, 6, "Printed: now", 50, 700)
    rows += line(2, 0, "Cup", 50, 20) + line(2, 1, "Result Segment score", 50, 40) + line(2, 2, "Printed:", 50, 60) + line(2, 3, "Withdrawn", 50, 300) + line(2, 4, "Liisa Kärki", 50, 320)
    return spark.createDataFrame(rows, SCHEMA)


def test_plan_and_redaction(spark):
    g = pages(spark)
    sizes = spark.createDataFrame([("p.pdf", p, 595.0, 842.0) for p in range(3)], "rel string, page int, width double, height double")
    patterns = spark.createDataFrame([("p.pdf", 0, pattern_of("Liisa Kärki"), "SUO")], "rel string, name_idx int, pattern string, club string")
    hits = glyphs.find_hits(g, patterns)
    got = {r.page: r for r in hits.collect()}
    assert set(got) == {0, 1, 2} and got[2].in_withdrawn and not got[1].in_withdrawn
    assert got[1].rect.x0 == 62.0 and len(got[1].club_rects) == 1 and got[1].club_rects[0].x0 == 200.0
    plan = protocol.plan(g, sizes, patterns, hits)
    assert [(r.page, r.type, r.action, r.heading) for r in plan.orderBy("page").collect()] == [(1, "podium", "remove_page", ""), (2, "results", "redact", "Results"), (3, "withdrawn_list", "redact", "Result Segment score")]
    ids = spark.createDataFrame([("p.pdf", ["c1-s1", "c2-s3"])], "rel string, ids array<string>")
    hashes = protocol.plan_hashes(plan, spark.createDataFrame([("p.pdf", "d" * 64)], "rel string, digest string"), ids)
    want = protocol.plan_hash("d" * 64, [(1, "podium", "remove_page", [0]), (2, "results", "redact", [0]), (3, "withdrawn_list", "redact", [0])], ["c1-s1", "c2-s3"])
    assert hashes.collect()[0].plan_hash == want
    assert protocol.confirmed(plan, hashes, hashes).count() == 3
    assert protocol.stale(hashes, hashes.withColumn("plan_hash", F.lit("old"))).count() == 1
    assert [tuple(r) for r in protocol.renumbered(sizes, plan).orderBy("page").select("page", "new_page").collect()] == [(1, 0), (2, 1)]
    left, written = glyphs.redact_glyphs(g, hits.where("page > 0"), sizes, {}, "Nimi poistettu pyynnöstä")
    text = {r.page: r.text for r in glyphs.page_texts(left).collect()}
    assert "KÄRKI" not in text[1] and "SUO" not in text[1] and "9.50" in text[1] and "Matti" in text[1] and "Liisa" in text[0]
    boxes = {r.page: r for r in written.collect()}
    assert boxes[1].box.x1 <= 258.01 and boxes[2].size == 10.0


def test_images_of_removed_pages(spark):
    images = spark.createDataFrame([("p", 0, "a"), ("p", 0, "b"), ("p", 1, "b")], "rel string, page int, sha256 string")
    plan = spark.createDataFrame([("p", 1, "remove_page")], "rel string, page int, action string")
    only = protocol.removed_only_images(images, plan)
    assert [r.sha256 for r in only.collect()] == ["a"]
    assert protocol.images_left(only, spark.createDataFrame([("p", "a")], "rel string, sha256 string")).count() == 1


def test_word_bags(spark):
    schema = "rel string, page int, x0 double, y0 double, x1 double, y1 double, word string"
    old = spark.createDataFrame([("p", 0, 0.0, 0.0, 9.0, 9.0, "name"), ("p", 0, 20.0, 0.0, 29.0, 9.0, "x"), ("p", 0, 40.0, 0.0, 49.0, 9.0, "x")], schema)
    boxes = spark.createDataFrame([("p", 0, [(0.0, 0.0, 10.0, 10.0)])], "rel string, page int, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert verify.word_checks(old, old.where("word = 'x'"), boxes, boxes).collect()[0].ok
    lost = verify.word_checks(old, old.where("x0 = 20"), boxes, boxes).collect()[0]
    assert not lost.ok and lost.missing == 1


def test_pdf_strings(spark):
    t = spark.createDataFrame([(r"(M\344ki) <FEFF0041006906E>",)], "t string").select(verify.pdf_strings(F.col("t"))).collect()[0][0]
    assert t.startswith("(Mäki) Ai")
