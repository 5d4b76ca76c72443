import pytest
from pyspark.sql import functions as F

from lodestone import queries as core
from oracle import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rrf_fusion", "protected_union", "hard_similar_random_negatives", "hr_mrr_ndcg", "segment_metrics", "rank_movement", "candidate_audit"])
def test_500_a_route_equals_its_sql(spark, name):
    assert core.oracle_sql()[f"{name}_500"] != core.oracle_sql()[name]
    assert_same(spark, FOLDER, core.queries()[f"{name}_500"], core.oracle_sql()[f"{name}_500"])


def test_fusion_keeps_more_than_three_routes_of_50(spark):
    assert core.queries()["rrf_fusion_500"](spark, FOLDER).agg(F.max("rank")).first()[0] > 150


def test_features_of_candidates_below_rank_50_are_known(spark):
    name = "ranking_features_500"
    assert_same(spark, FOLDER, core.queries()[name], core.oracle_sql()[name])
    places = spark.read.parquet(f"{FOLDER}/business_fact_versions.parquet").where("latitude is not null and longitude is not null").select("business_id").distinct()
    rows = core.queries()[name](spark, FOLDER).cache()
    placed = rows.join(rows.where("not location_missing").select("task_id").distinct(), "task_id").join(places, "business_id")
    assert placed.where("not location_missing").groupBy("task_id").count().agg(F.max("count")).first()[0] > 50
    assert rows.where("category > 0").groupBy("task_id").count().agg(F.max("count")).first()[0] > 50
