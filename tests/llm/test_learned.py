import re
import zlib

import numpy as np
import pytest

from veilspark.llm import html_pages, html_text, toxicity


@pytest.fixture(scope="module")
def extractor():
    return html_pages.trained()


def test_held_out_pages(extractor):
    made, right = html_pages.Pages(77), 0
    for _ in range(120):
        page = made.page()
        want = re.sub(r"\s", "", html_text.html.unescape("".join(p.split(html_pages.CLOSE)[0] for p in page.split(html_pages.OPEN)[1:])))
        right += re.sub(r"\s", "", extractor.texts([page.replace(html_pages.OPEN, "").replace(html_pages.CLOSE, "")])[0]) == want
    assert right >= 90


def test_tables_pages(spark, small, extractor):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_texts(pages, extractor).collect()}
    right = 0
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        right += got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right >= 0.98 * pages.count()


def test_broken_pages(spark, extractor):
    odd = [None, "", "<", "<p", "<!-- x", "<script>var a", "<div class='a", "</p></div>", "<table><tr><td>a<td>b", "<a href=\"x>y</a>" * 50, "<div>" * 3000 + "deep", "&amp;&#x41;&bogus;", "\x00<p>\x00"]
    df = spark.createDataFrame([(k, None, p, "own") for k, p in enumerate(odd)], "page_id long, url string, html string, text string")
    got = html_text.main_texts(df, extractor).orderBy("page_id").collect()
    assert [r.page_id for r in got] == list(range(len(odd))) and got[0].text == "" and got[0].n_chars == 0


def test_elements_that_nothing_ends(extractor):
    words = lambda page: " ".join(t for n in html_text.parse(page) for t in n.kids if isinstance(t, str)).split()
    assert words('<p>a</p><svg><path d="x"><p>hello') == ["a", "hello"]
    assert sorted(words("<div>a<canvas>x<b>y</div>z")) == ["a", "z"] and words("<p>a<math><mi>x<div>b</div>") == ["a", "b"]
    assert words("<p>a<select><option>x</select>b") == ["a", "b"] and words("<p>a<object>x<p>y</object>b") == ["a", "b"]
    assert words("<p>a<option>x<p>b") == ["a", "b"] and words("<p>a<svg><title>t</title></svg>b") == ["a", "b"]


def test_pages_table_edges(spark, extractor):
    rows = [(1, "u", "<article><p>" + "word " * 60_000 + "</article>"), (1, "u", "<article><p>x"), (1, "u", "<article><p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_text.main_texts(df, extractor).count() == 3 and html_text.main_texts(df.limit(0), extractor).count() == 0


def test_boosters_learn():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(2000, html_text.WIDTH)), rng.integers(0, 2, (2000, 5))]).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, html_text.WIDTH + 2] > 0)).astype(float)
    p = html_text.Booster(depth=3, rounds=30).fit(x[:1500], y[:1500], np.ones(1500)).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97


def test_string_kernel_is_the_sum_over_triples():
    def image(word):
        codes = [0, *map(toxicity.letters.__getitem__, word), 0]
        out = {}
        for i, j, k, w in toxicity.triples(len(codes)):
            out[codes[i], codes[j], codes[k]] = out.get((codes[i], codes[j], codes[k]), 0) + w
        return out

    words = ["idiot", "idiiot", "id.iot", "a", "banana", "ünïcode"]
    table = toxicity.images(words)
    got = toxicity.against(words, table)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = image(a), image(b)
            want = sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert abs(got[i, j] - want) < 1e-5


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, model).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held) and sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in got)
    assert np.mean([got[k].predicted == truth[k] for k in held]) >= 0.95
    odd = spark.createDataFrame([(1, None, 5.0), (1, "", 1.0), (None, "x " * 20000, None), (2, "y" * 5000, 0.0)], "doc_id long, text string, score double")
    rows = toxicity.toxicity_report(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_report(odd.limit(0), model).count() == 0
