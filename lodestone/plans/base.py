"""Typed base tables that several queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import table


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, user_id, business_id, stars, t): one row a review; repeated deliveries agree on these."""
    rows = table(spark, folder, "reviews", "review_id", "user_id", "business_id", "stars", "review_time").dropna()
    return rows.groupBy("review_id").agg(F.min("user_id").alias("user_id"), F.min("business_id").alias("business_id"), F.min("stars").alias("stars"), F.min("review_time").alias("t"))


def businesses(spark: SparkSession, folder: str) -> DataFrame:
    """The version of each business with the latest effective time, then recording, then id."""
    order = Window.partitionBy("business_id").orderBy(F.col("effective_time").desc_nulls_last(), F.col("recorded_time").desc_nulls_last(), F.col("version_id").desc())
    versions = table(spark, folder, "business_fact_versions").where("business_id is not null")
    return versions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """(task_id, split, user_id, cutoff_time, history_count), repeated rows once."""
    return table(spark, folder, "temporal_contexts", "task_id", "split", "user_id", "cutoff_time", "history_count").distinct()


INTER = """inter as (
  select review_id, min(user_id) user_id, min(business_id) business_id, min(stars) stars, min(review_time) t from reviews
  where user_id is not null and business_id is not null and stars is not null and review_time is not null and review_id is not null group by review_id)"""
BIZ = """biz as (
  select * exclude (r) from (select *, row_number() over (partition by business_id
    order by effective_time desc nulls last, recorded_time desc nulls last, version_id desc) r
    from business_fact_versions where business_id is not null) where r = 1)"""
TASKS = "tasks as (select distinct task_id, split, user_id, cutoff_time, history_count from temporal_contexts)"
