import json
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files as X


def test_archive_and_json_sources(spark, tmp_path):
    rows = [{"business_id": "b1", "city": "Tampa", "is_open": 1, "review_count": 5, "categories": "Bars, Vegan", "attributes": {"a": 1}}, {"business_id": "b2", "city": "Tampa", "is_open": 0, "review_count": 5, "categories": "Bars"}, {"business_id": "b3", "city": "Reno", "is_open": 1}]
    (tmp_path / "business.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        tar.add(tmp_path / "business.json", "business.json")
    assert set(X.archive_members(tmp_path / "all.tar", ["business.json"])) == {"business.json"}
    with pytest.raises(FileNotFoundError):
        X.archive_members(tmp_path / "all.tar", ["user.json"])
    (path,) = X.extract_members(tmp_path / "all.tar", ["business.json"], tmp_path / "out")
    good, bad = X.json_lines(spark, str(path), X.BUSINESS)
    assert (good.count(), bad.count()) == (3, 1)
    kept, rejected = X.curated_businesses(good, "tampa", ["Vegan"])
    assert [(r.business_id, r.categories, r.attributes_json) for r in kept.collect()] == [("b1", ["Bars", "Vegan"], '{"a":1}')]
    assert {r.reason: r.n for r in rejected.collect()} == {"closed": 1, "city": 1}
    reviews = spark.createDataFrame([("r1", "u", "b1", 5.0, "t", "2024-01-01 10:00:00"), ("r2", "u", "b1", 9.0, "t", "2024-01-01 10:00:00"), ("r3", "u", "b1", 3.0, "t", "soon"), ("r4", "u", "zz", 3.0, "t", "soon")], "review_id string, user_id string, business_id string, stars double, text string, date string")
    fine, wrong = X.curated_reviews(reviews, kept)
    assert [r.review_id for r in fine.collect()] == ["r1"] and {r.reason: r.n for r in wrong.collect()} == {"stars": 1, "date": 1}


def test_only_selected_users_with_their_time(spark):
    raw = spark.createDataFrame([("u1", "A", "2020-02-03 04:05:06"), ("u2", "B", "soon"), ("u3", "C", None), (None, "D", None)], "user_id string, name string, joined string")
    got = X.curated_users(raw, spark.createDataFrame([("u1",), ("u2",), ("u2",)], "user_id string"), "joined").collect()
    assert sorted((r.user_id, str(r.since)) for r in got) == [("u1", "2020-02-03 04:05:06"), ("u2", "None")]


def test_strict_cast_and_reuse_by_hash(spark, tmp_path):
    df = spark.createDataFrame([("1",), (None,)], "a string")
    with pytest.raises(Exception, match="null in required column a"):
        X.strict_cast(df, "a int not null").collect()
    source = tmp_path / "in.parquet"
    X.write_parquet(df.dropna(), str(source), "a int not null")
    calls = []
    build = lambda: calls.append(1) or spark.read.parquet(str(source)).withColumn("b", F.lit(1))
    for config in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert X.built_once(spark, str(tmp_path / "out"), [source], config, build).count() == 1
    assert len(calls) == 2


def test_reports_are_whole_or_refused(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.lit("a|b"))
    X.csv_report(df, tmp_path / "r.csv")
    X.markdown_report(df, tmp_path / "r.md", "Title")
    assert (tmp_path / "r.csv").read_text().count("\n") == 4 and "a\\|b" in (tmp_path / "r.md").read_text()
    with pytest.raises(ValueError):
        X.csv_report(df, tmp_path / "r.csv", limit=2)
    assert not list(tmp_path.glob("*.partial"))


def test_vector_cache_encodes_each_text_once(spark, tmp_path):
    cache = X.VectorCache(spark, str(tmp_path / "cache"))
    encoder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("ab",), ("ab",), ("c",), (None,)], "t string")
    assert sorted((r.t, list(r.vector)) for r in cache.encode(df, "t", encoder).collect() if r.t) == [("ab", [2.0, 1.0]), ("ab", [2.0, 1.0]), ("c", [1.0, 1.0])]
    cache.encode(df, "t", encoder)
    assert cache.spark.read.parquet(cache.path).count() == 2


def test_streamed_state_equals_the_batch(spark, tmp_path):
    from lodestone.streaming.latest import drain, latest_ratings

    rows = [("u", "b", "r1", 5.0, "2024-01-02"), ("u", "b", "r0", 1.0, "2024-01-01"), ("u", "b", "r2", 2.0, "2024-01-03"), ("v", "b", "r3", 4.0, "2024-01-01")]
    for i, r in enumerate(rows):  # a file each, so several micro-batches can see them
        spark.createDataFrame([r], "user_id string, business_id string, review_id string, stars double, d string").selectExpr("user_id", "business_id", "review_id", "stars", "cast(d as timestamp_ntz) t").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("user_id string, business_id string, review_id string, stars double, t timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    drain(latest_ratings(source), str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert ("u", "b", 2.0) in {(r.user_id, r.business_id, r.stars) for r in got} and ("v", "b", 4.0, None) in {(r.user_id, r.business_id, r.stars, r.retracted) for r in got}


def test_latest_ratings_over_two_batches(spark, tmp_path):
    from lodestone.streaming.latest import current_ratings, drain, latest_ratings

    schema = "user_id string, business_id string, review_id string, stars double, t timestamp_ntz"
    batches = [[("u", "b", "r1", 2.0, 5), ("u", "c", "r2", 3.0, 1)], [("u", "b", "r3", 4.0, 9), ("u", "c", "r0", 1.0, 1), ("v", "b", "r4", 5.0, 0)], [("u", "b", "r5", 1.0, 7)]]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(*r[:4], f"2024-01-{r[4] + 1:02d}") for r in rows], "user_id string, business_id string, review_id string, stars double, d string")
        made.selectExpr("user_id", "business_id", "review_id", "stars", "cast(d as timestamp_ntz) t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    drain(latest_ratings(source), str(tmp_path / "out"))
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in current_ratings(changes).collect()} == {("u", "b", 4.0), ("u", "c", 3.0), ("v", "b", 5.0)}
    assert changes.where("business_id = 'b' and user_id = 'u' and retracted is not null").count() >= 1


def test_windowed_counts_keep_the_last_update(spark, tmp_path):
    from lodestone.streaming.latest import last_update, upsert_batches, windowed_counts

    for i, days in enumerate([(1, 1, 2), (2, 20), (21,), (1, 22)]):  # the last 1 is behind the watermark
        spark.createDataFrame([(f"2024-01-{d:02d}",) for d in days], "d string").selectExpr("cast(d as timestamp) ts", "'x' k").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    upsert_batches(windowed_counts(source, "ts", ["k"]), str(tmp_path / "out"))
    got = last_update(spark.read.parquet(str(tmp_path / "out")), ["window_start", "k"]).selectExpr("day(window_start) d", "n").collect()
    assert {(r.d, r.n) for r in got} == {(1, 2), (2, 2), (20, 1), (21, 1), (22, 1)}
