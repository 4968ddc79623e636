"""Nulls, long texts, ties, repeated rows, empty tables and clashing columns, and held-out measures."""

import zlib

import corpus_pipeline
from veilspark.llm import embeddings, mixing, quality, toxicity, urls

CLASHES = ["_kept", "_failed", "_stats", "_gone", "__id", "_may", "row", "size", "digest", "n"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES)


def documents(spark):
    text = " ".join(f"word{k}" for k in range(40))
    long = " ".join(f"long{k}" for k in range(30_000))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " end", "en", None, 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, text, "en", "b", 1), (5, long, "en", "c", 1), (6, "short one", "en", "b", 1)]
    return spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], COLUMNS)


def test_stages_of_the_pipeline_on_odd_rows(spark, small):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
    kept = [r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, small).collect()]
    assert not {3, 4, 6} & set(kept)
    cut = sorted((r.doc_id or 0, r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, small).where("doc_id IS NULL OR doc_id <> 5").collect() if r.text is not None)
    assert [c[0] for c in cut] == [0, 1, 1, 2, 4, 6] and cut[3][1:] == ("", 0) and cut[1][1] == cut[0][1]
    left = sorted(r.doc_id or 0 for r in corpus_pipeline.keep_one(spark, docs, small).collect())
    assert left == [0, 1, 1, 3, 4, 5, 6]
    assert {r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, small).collect()} <= {1, 2, 3, 4, 5, 6, None}
    done = corpus_pipeline.encode(spark, docs, small).collect()
    assert len(done) == 8 and sum(r.n_tokens == 0 for r in done) == 2
    assert corpus_pipeline.encode(spark, docs.limit(0), small).count() == 0


def test_quality_of_odd_rows(spark):
    got = quality.quality_report(documents(spark), []).collect()
    assert len(got) == 8 and all(r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 6)) and all(r.kept for r in got if r.doc_id in (1, 2, 5))
    assert quality.quality_report(documents(spark).limit(0), []).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 0), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    assert [(r["doc_id"], r["bad"]) for r in quality.labelled(documents(spark), labels)] == [(1, True)]


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.labelled(docs, labels)
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    rules = quality.learn([r for r in rows if not held(r)])
    bad, good = ([any(quality.matches(x, r) for x in rules) for r in rows if held(r) and r["bad"] == b] for b in (True, False))
    assert sum(bad) >= 0.8 * len(bad) > 0 and sum(good) <= 0.02 * len(good)


def test_long_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/" + "p" * 50_000, "allow")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/" + "p" * 60_000), (1, "http://" + "b." * 20_000 + "net/"), (1, "http://" + "b." * 20_000 + "net/")], "page_id long, url string")
    assert sorted(r.verdict for r in urls.filter_urls(df, rules).collect()) == ["allow", "block", "block"]


def test_repeated_vector_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = embeddings.near_vectors(df).collect()
    assert len(got) == 4 and {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_toxicity_learns_from_one_text_of_a_document(spark):
    rows = [(k, f"plain words here number {k}") for k in range(60)] + [(k, f"you utter blockhead {k} {k}") for k in range(60, 120)]
    docs = spark.createDataFrame(rows + [(61, "another text")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(120)], "doc_id long, toxic int")
    a, b = (toxicity.learn(d, labels) for d in (docs, docs.repartition(7)))
    texts = ["a blockhead", "plain words", "", None]
    assert a.scores(texts) == b.scores(texts) and a.scores(texts)[0] > 0.5 > max(a.scores(texts)[1:])


def test_targets_come_from_rounds(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    assert got["a"] == 30 and got["c"] == 3 and got[None] == 150 and abs(got["b"] - 878) < 1e-9
