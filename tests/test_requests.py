from lodestone.operators import text as T
from lodestone.plans import evaluation


def test_requests_make_no_row_for_a_term(spark):
    for query in (evaluation.bm25_passages_of_requests, evaluation.hybrid_passages_of_requests):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_scopes_that_go_on_in_the_next_batch(spark):
    docs = spark.createDataFrame([(s, i, "soup " * (i % 3 + 1) + ("bread" if i % 2 else "tea")) for s in "ab" for i in range(30)] + [("c", 99, None)], "s string, d int, t string")
    requests = spark.createDataFrame([(f"q{i}", s, text) for s in "abz" for i, text in enumerate(("bread soup", "nothing", None, "tea tea"))], "q string, s string, w string")
    how = (docs, requests, "s", "d", "t", "q", "w")
    whole = {tuple(r) for r in T.bm25_requests(*how).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in T.bm25_requests(*how).collect()} == whole
        first = {tuple(r) for r in T.bm25_requests(*how, top=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert first == {r for r in whole if r[4] <= 2} and len(first) == 2 * 2 * 2 and len(whole) == 2 * (30 + 15)
