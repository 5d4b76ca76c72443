from lodestone.llm import queries


def test_short_copies_are_grouped(spark, tmp_path):
    rows = [("a", "Great food!"), ("b", "Great food!"), ("c", "one two three four five six seven"), ("d", "one two three four five six seven"), ("e", "quite alone"), ("f", " "), ("g", " ")]
    spark.createDataFrame(rows, "review_id string, text string").write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame([("s", "Great food!")], "segment_id string, segment_text string").write.parquet(f"{tmp_path}/review_segments.parquet")
    got = {(r.record_kind, r.record_id): (r.group_id, r.n_links) for r in queries.p1_groups(spark, str(tmp_path)).collect()}
    assert got == {("review", "a"): ("a", 1), ("review", "b"): ("a", 1), ("review", "c"): ("c", 1), ("review", "d"): ("c", 1), ("review", "e"): ("e", 0), ("review", "f"): ("f", 0), ("review", "g"): ("g", 0), ("segment", "s"): ("s", 0)}
