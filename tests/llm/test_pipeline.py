from collections import Counter

import corpus_pipeline
from veilspark.llm import lines, quality
from veilspark.llm.shingles import shingle_set


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    start = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rules = quality.learn(quality.labelled(start, labels))
    assert sorted(r.doc_id for r in kept[0].collect()) == sorted(r.doc_id for r in quality.quality_report(start, rules).where("kept").collect())
    texts = {r.doc_id: r for r in kept[1].collect()}
    assert len(texts) == kept[0].count() and all(r.n_chars == len(r.text) for r in texts.values())
    long = Counter(frozenset(w) for r in texts.values() for w in map(lines.words_of, r.text.encode().split(b"\n")) if w)
    assert max(long.values()) == 1
    sets = {k: set(shingle_set(r.text).tolist()) for k, r in texts.items()}
    left = {r.doc_id for r in kept[2].collect()}
    for k in texts:
        near = [j for j in texts if j < k and sets[j] and sets[k] and 100 * len(sets[j] & sets[k]) >= 85 * len(sets[j] | sets[k])]
        assert (k in left) == (not near)
    times = Counter(r.doc_id for r in kept[3].collect())
    assert set(times) <= left and max(times.values()) <= 3
    assert kept[4].count() == kept[3].count()
    assert corpus_pipeline.run(spark, small).count() == kept[4].count()
