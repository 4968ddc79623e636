from veilspark.operators import verify
from veilspark.plans import queries


def test_whole_terms_are_found_across_lines(spark):
    long = "alpha beta gamma " + "delta " * 12
    docs = spark.createDataFrame([(0, f"x\n{long}end of it"), (1, f"{long}other end"), (2, "one two\nthree four"), (3, "one two three four")], "doc_id long, text string")
    terms = spark.createDataFrame([(0, long + "end of it"), (1, "one two\nthree four")], "subject_idx long, term string")
    got = sorted(tuple(r) for r in verify.residual_whole(docs, "doc_id", "text", terms).collect())
    assert got == [(0, 2, 0), (2, 0, 1)]


def test_top_is_a_share_of_the_text(spark, tmp_path):
    rows = [(0, "x" * 500 + " stupid " + "x" * 1500), (1, "x" * 500 + " stupid " + "x" * 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.type for r in queries.QUERIES["plan_classify"](spark, str(tmp_path)).collect()}
    assert got == {0: "podium", 1: "other"}
