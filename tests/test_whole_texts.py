import pytest
from pyspark.sql import functions as F

from lodestone import queries as core
from lodestone.operators import text as T
from oracle import assert_same


def test_overlapping_passages_reach_the_end_of_a_long_text(spark):
    long = " ".join(f"This is sentence number {i} of a very long review." for i in range(400)) + "\n" + "x" * 897 + ".\nBye."
    df = spark.createDataFrame([("a", long), ("b", "Short one. Fine."), ("c", "  "), ("d", None)], "id string, t string")
    got = {}
    for r in T.segments(df, "id", "t", overlap=True).orderBy("segment_index").collect():
        got.setdefault(r.id, []).append(r)
    assert set(got) == {"a", "b"} and "truncated" not in T.segments(df, "id", "t", overlap=True).columns
    spans = [(r.char_start, r.char_end) for r in got["a"]]
    assert len(spans) > 8 and spans[-1] == (len(long) - 4, len(long)) and got["a"][-1].segment_text == "Bye."
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered or ch.isspace() for i, ch in enumerate(long))
    assert all(b - a <= 900 for a, b in spans) and any(a < e for (a, _), (_, e) in zip(spans[1:], spans))


def test_separate_passages_tell_whether_the_text_goes_on(spark):
    sentence = "y" * 890 + ". "
    df = spark.createDataFrame([("eight", sentence * 8), ("nine", sentence * 9)], "id string, t string")
    rows = T.segments(df, "id", "t").collect()
    assert {(r.id, r.truncated) for r in rows} == {("eight", False), ("nine", True)} and len(rows) == 16


def test_words_of_every_script(spark):
    df = spark.createDataFrame([("Café Größe don't 很好吃 OK 停",), ("",)], "t string")
    assert [r.w for r in df.select(T.unicode_words(F.col("t")).alias("w")).collect()] == [["café", "größe", "don't", "ok", "很好", "好吃", "停"], []]
    docs = spark.createDataFrame([("b", 1, "这里停车方便"), ("b", 2, "味道很好"), ("b", 3, "plain words")], "s string, d int, t string")
    assert {r.d for r in T.bm25(docs, "s", "d", "t", ["停车"], words=T.unicode_words).where("score > 0").collect()} == {1}


@pytest.mark.parametrize("name", ["bm25_top_per_business", "tfidf_cosine_to_business", "top_keywords"])
def test_unicode_query_equals_its_sql(spark, name):
    assert core.oracle_sql()[f"{name}_unicode"] != core.oracle_sql()[name]
    assert_same(spark, "/root/testdata/sf0.01", core.queries()[f"{name}_unicode"], core.oracle_sql()[f"{name}_unicode"])
