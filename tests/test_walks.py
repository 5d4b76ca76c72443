import datetime

import pyarrow as pa
import pytest

from lodestone.operators import catalogue as K
from lodestone.plans import composites, evaluation, knowledge, recommend

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def batch(rows):
    history = pa.list_(pa.struct([("business_id", pa.string()), ("n", pa.int64()), ("s", pa.float64()), ("liked", pa.int64()), ("disliked", pa.int64())]))
    schema = pa.schema([("slice", pa.int32()), ("business_id", pa.string()), ("n", pa.int64()), ("s", pa.float64()), ("task_id", pa.string()), ("history", history), ("wanted", pa.list_(pa.string()))])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)


def test_a_walk_returns_tasks_before_it_has_read_the_slice(spark):
    items = spark.createDataFrame([(f"b{i}", 1.0, 2.0, ["x"]) for i in range(4)], "business_id string, latitude double, longitude double, categories array<string>")
    read = []

    def batches():
        for i in range(3):
            read.append(i)
            yield batch([(0, f"b{i}", 2, 8.0, None, None, None), (0, None, None, None, f"t{i}", [{"business_id": "b0", "n": 1, "s": 4.0, "liked": 1, "disliked": 0}] if i == 2 else None, ["b1", "gone"])])

    walk = K._Walk(K.catalogue(items), {"quality": 3, "fused": 4}, (), {"quality": 1.0}, 3, 60.0)
    seen = []
    for task in walk.over(batches()):
        seen.append((task.name, len(read), task.chosen["quality"].tolist(), task.chosen["fused"].tolist(), task.wanted.tolist()))
    assert seen == [("t0", 1, [0], [0], [1]), ("t1", 2, [0, 1], [0, 1], [1]), ("t2", 3, [1, 2], [1, 2], [1])]


def test_many_tasks_of_one_slice_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(K, "OUT_ROWS", 7)
    parts = list(K._batches(iter([(3, {"a": [1, 2, 3]})] * 10), "a int", lambda _, p: pa.array([x for y in p for x in y], pa.int32())))
    assert [len(p) for p in parts] == [9, 9, 9, 3]


def test_negatives_are_chosen_where_they_are_ranked(spark):
    text = plan(recommend.hard_similar_random_negatives_500(spark, FOLDER))
    assert "MapInArrow" in text and "FlatMapCoGroups" not in text and "LeftAnti" not in text


@pytest.mark.parametrize(
    "query",
    [evaluation.paired_retrieval_comparison, recommend.protected_union_500, knowledge.rank_movement_500, composites.candidate_audit_500, evaluation.calibration_dataset, evaluation.route_recall, lambda spark, folder: knowledge._both_ranks(spark, folder)],
    ids=["F3", "F4", "F5", "F6", "F9", "F10", "F8"],
)
def test_a_query_walks_once_and_batchwise(spark, query):
    text = plan(query(spark, FOLDER))
    assert text.count("MapInArrow") == 1 and "FlatMapCoGroups" not in text


def test_a_task_of_two_targets_meets_both_ranks_as_in_sql(spark, tmp_path):
    import duckdb

    from lodestone import queries as core
    from oracle import assert_same

    con = duckdb.connect()
    for name in ("reviews", "temporal_contexts", "business_fact_versions"):
        con.execute(f"create table {name} as select * from '{FOLDER}/{name}.parquet'")
    # each target's user rates the next business at the same instant
    con.execute("insert into reviews by name select * replace ('twin-' || review_id as review_id, (select max(business_id) from reviews) as business_id) from reviews where (user_id, review_time) in (select user_id, cutoff_time from temporal_contexts)")
    for name in ("reviews", "temporal_contexts", "business_fact_versions"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    for name in ("rank_movement_500", "bootstrap_ci", "paired_retrieval_comparison"):
        assert_same(spark, str(tmp_path), core.queries()[name], core.oracle_sql()[name])
