"""Queries of the point-in-time and skew operators on the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.asof import as_known
from lodestone.operators.selection import keyed_selection
from lodestone.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    times = table(spark, folder, "reviews", "review_id", "review_time").where("review_id is not null and review_time is not null").groupBy("review_id").agg(F.min("review_time").alias("t"))
    segments = table(spark, folder, "review_segments", "segment_id", "review_id", "business_id").where("business_id is not null and review_id is not null")
    events = segments.join(times, "review_id").select(c("segment_id").alias("event_id"), c("business_id").alias("entity"), "t")
    facts = table(spark, folder, "business_fact_versions", "version_id", "business_id", "effective_time", "recorded_time").toDF("id", "entity", "valid_from", "recorded")
    tasks = table(spark, folder, "temporal_contexts", "task_id", "user_id", "cutoff_time").toDF("event_id", "entity", "t")
    profiles = table(spark, folder, "profile_snapshots", "profile_id", "user_id", "cutoff_time", "recorded_time").toDF("id", "entity", "valid_from", "recorded")
    both = as_known(events, facts).withColumn("event_kind", F.lit("segment")).unionByName(as_known(tasks, profiles).withColumn("event_kind", F.lit("task")))
    return both.where("attribute_id is not null").select("event_kind", "event_id", "attribute_id").distinct()


def _distinct_reviews(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "reviews", "business_id", "review_id", "review_time").where("business_id is not null and review_id is not null")
    return reviews.groupBy("business_id", "review_id").agg(F.min("review_time").alias("review_time"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # a count is the sum of the merged histogram's bins; no rank is open, so no bin is refined
    true = keyed_selection(_distinct_reviews(spark, folder), "business_id", "review_time", ()).select("business_id", "n")
    scores = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "business_total_review_count").where("business_total_review_count is not null")
    wrong = scores.join(true, "business_id", "left").where(F.col("business_total_review_count") != F.coalesce("n", F.lit(0)))
    return wrong.select("business_id", "aspect_id").distinct()


def p3_review_times(spark: SparkSession, folder: str) -> DataFrame:
    probs = (0.1, 0.5, 0.9)
    found = keyed_selection(_distinct_reviews(spark, folder), "business_id", "review_time", probs)
    return found.select("business_id", "n", *(F.element_at("quantiles", i + 1).alias(f"p{round(p * 100)}_micros") for i, p in enumerate(probs)))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_review_times": p3_review_times}

SQL = {
    "p2_found": """
with times as (select review_id, min(review_time) t from reviews where review_time is not null group by 1),
ev as (
  select distinct 'segment' event_kind, segment_id event_id, business_id entity, t from review_segments join times using (review_id)
  union all
  select distinct 'task', task_id, user_id, cutoff_time from temporal_contexts),
ver as (
  select 'segment' event_kind, version_id id, business_id entity, effective_time valid_from, recorded_time recorded from business_fact_versions
  union all
  select 'task', profile_id, user_id, cutoff_time, recorded_time from profile_snapshots),
ranked as (
  select e.event_kind, e.event_id, v.id attribute_id,
    row_number() over (partition by e.event_kind, e.event_id, e.t, e.entity order by v.valid_from desc, v.recorded desc, v.id desc) r
  from ev e join ver v on e.event_kind = v.event_kind and e.entity = v.entity and v.valid_from <= e.t and v.recorded <= e.t)
select distinct event_kind, event_id, attribute_id from ranked where r = 1
""",
    "p3_found": """
with true_counts as (select business_id, count(distinct review_id) n from reviews where business_id is not null group by 1)
select distinct a.business_id, a.aspect_id from aspect_scores a left join true_counts t using (business_id)
where a.business_total_review_count is not null and a.business_total_review_count <> coalesce(t.n, 0)
""",
    "p3_review_times": """
with d as (select business_id, review_id, min(review_time) rt from reviews where business_id is not null and review_id is not null group by all),
r as (select business_id, epoch_us(rt) v, row_number() over (partition by business_id order by rt) k, count(rt) over (partition by business_id) nv from d where rt is not null),
n as (select business_id, count(*) n from d group by 1)
select n.business_id, n.n,
  max(v) filter (where k = greatest(1, ceil(0.1::double * nv))) p10_micros,
  max(v) filter (where k = greatest(1, ceil(0.5::double * nv))) p50_micros,
  max(v) filter (where k = greatest(1, ceil(0.9::double * nv))) p90_micros
from n left join r using (business_id) group by all
""",
}
