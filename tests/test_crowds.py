"""Many names, lines and pages at once: the same results as by trying everything, without trying it."""

import random
import time

from pyspark.sql import functions as F

from veilspark.functions import text
from veilspark.operators import glyphs, redact, verify
from veilspark.plans import protocol
from veilspark.sources import events

from test_glyphs import SCHEMA, line, pages

NAMES = ["Liisa Kärki", "Kärki", "aa bb", "bb aa bb", "O'Brien-Smith, Ann", "x|y z", "a.b c", "#", "¤ §", "one two three four five", "aa,bb  cc", "Straße & Co", "ß x"]


def test_tokens_of_a_pattern():
    for name in NAMES:
        assert text.tokens_in(text.pattern_of(name)) in [list(o) for o in text.orders_of(text.tokens_of(name))]
    assert text.tokens_in("(?<!\\w)(?:a.c)(?!\\w)") == [] and text.tokens_in("a+") == []


def test_finder_finds_what_each_pattern_finds():
    dice = random.Random(5)
    patterns = [text.pattern_of(n) for n in NAMES] + [None, "a+b", text.pattern_of(NAMES[0])]
    parts = [t for n in NAMES for t in text.tokens_of(n)] + [",", " ", ", ,", "-", "\n", "x", "aab", "é"]
    for _ in range(3000):
        t = "".join(dice.choice(parts) + dice.choice(["", " ", " ", ",", "."]) for _ in range(dice.randint(0, 9)))
        assert text.Finder(patterns).subjects(t) == {k for k, p in enumerate(patterns) if p and text.compiled(p).search(t)}, t


def test_a_page_of_many_names_is_searched_in_time():
    names = [f"Ann Person{k:05d}" for k in range(4000)]
    page = "\n".join(f"<td>{n}</td>" for n in names[:2000])
    began = time.time()
    found = verify.leftovers(page, [text.pattern_of(n) for n in names])
    assert found == [(f"line {k + 1}", k) for k in range(2000)]
    assert time.time() - began < 20  # trying each on each line takes minutes


def test_splice_of_edits_within_one_another():
    edits = [(1, 3, "X"), (5, 5, "Y"), (7, 8, "")]
    assert redact.spliced("abcdefghij", edits) == "aXdeYfgij"
    assert redact.spliced("abcdefgh", [(1, 7, "X"), (3, 4, "long")]) == "aXefgh"


def odd_page(spark):
    rows = line(3, 0, "`Aa Bb ", 50, 100) + line(3, 1, "CLUB", 300, 101.9) + line(3, 2, "CLUB", 200, 119) + line(3, 3, "far", 280, 98.1) + line(3, 4, "# x", 50, 139.5) + line(3, 5, "withdrawn:", 50, 120)
    rows += [("p.pdf", 3, 6, k, c, 50.0 + 6 * k, y - 9, 56.0 + 6 * k, y + 2, 50.0 + 6 * k, y, 10.0, False) for k, (c, y) in enumerate(zip("aa bb CLUB", [160.0] * 5 + [1e300] * 5))]
    return pages(spark).union(spark.createDataFrame(rows, SCHEMA))


def test_lines_and_glyphs_give_the_same(spark):
    g = odd_page(spark)
    lines = glyphs.lines_of(g)
    names = [(0, text.pattern_of("Liisa Kärki"), "SUO"), (1, text.pattern_of("aa bb"), "Club"), (2, text.pattern_of("#"), ""), (3, text.pattern_of("aa bb"), "Club"), (4, None, "x")]
    patterns = spark.createDataFrame([("p.pdf", *n) for n in names], "rel string, name_idx int, pattern string, club string")
    hits = glyphs.find_hits(g, patterns)
    place = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert place(hits) == place(glyphs.find_hits(lines, patterns))
    got = sorted((r.page, r.line_no, r.hit_no, r.name_idx, len(r.club_rects) and r.club_rects[0].x0, r.in_withdrawn) for r in hits.collect())
    assert [x for x in got if x[0] == 3] == [(3, 0, 0, 1, 300.0, False), (3, 0, 1, 3, 300.0, False), (3, 4, 0, 2, 0, True), (3, 6, 0, 1, 0, True), (3, 6, 1, 3, 0, True)]
    assert {r.line_no: r.next_x for r in glyphs.next_text(lines, hits).where("page = 3").collect()} == {0: 280.0, 4: 62.0, 6: None}
    sizes = spark.createDataFrame([("p.pdf", p, 595.0, 842.0) for p in range(4)], "rel string, page int, width double, height double")
    a, b = glyphs.redact_glyphs(g, hits, sizes, {}, "x" * 9), glyphs.redact_glyphs(lines, hits, sizes, {}, "x" * 9)
    assert place(a[0]) == place(b[0].select("rel", "page", "line_no", F.inline("glyphs"))) and place(a[1]) == place(b[1])
    boxes = [(r.page, x) for r in hits.collect() for x in [r.rect, *r.club_rects]]
    meets = lambda q, x: q.x0 < x.x1 and q.x1 > x.x0 and q.y0 < x.y1 - (x.y1 - x.y0) * glyphs.INSET and q.y1 > x.y0 + (x.y1 - x.y0) * glyphs.INSET
    assert place(a[0]) == sorted(repr(q) for q in g.select(*sorted(g.columns)).collect() if not any(p == q.page and meets(q, x) for p, x in boxes))
    assert place(protocol.plan(g, sizes, patterns, hits)) == place(protocol.plan(lines, sizes, patterns, hits))


def test_lines_of_events_are_lines_of_their_glyphs(spark, small):
    drawn = events.protocol_lines(events.glyph_rows(spark, small).where("event_id = 'ev1'"))
    by = lambda df: sorted(map(repr, df.collect()))
    assert by(glyphs.lines_of(events.glyphs(drawn))) == by(events.glyph_lines(drawn).select("rel", "page", "line_no", "glyphs"))
