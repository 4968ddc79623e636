import corpus_pipeline
from veilspark.llm import neardup
from veilspark.llm.shingles import shingle_set


def test_stage_drops_copies_from_a_similarity_of_80_percent(spark, small):
    base = [f"w{k}" for k in range(104)]
    rows = []
    for k, changed in enumerate((0, 2, 11)):  # 100 shingles; a change far from others costs five
        text = list(base)
        for n in range(changed):
            text[8 * n + 8] = f"x{k}-{n}"
        rows.append((k, " ".join(text)))
    sets = [set(shingle_set(t).tolist()) for _, t in rows]
    assert 80 * len(sets[0] | sets[1]) <= 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.keep_one(spark, docs, small).collect()} == {0, 2}
    assert neardup.trees_for(85) == neardup.TREES and (1 - 0.8**4) ** neardup.trees_for(80) < 2.2e-8
