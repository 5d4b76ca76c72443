"""Stateful queries: latest ratings, folds, streams drained to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.state import fold_sessions, latest_per_pair, preference_fold
from lodestone.plans.base import BIZ, INTER, businesses, interactions
from lodestone.sources.tables import table
from lodestone.sources.workspace import scratch_path
from lodestone.streaming.latest import current_ratings, drain, last_update, latest_ratings, upsert_batches, windowed_counts

c = F.col


def latest_per_pair_query(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_pair(interactions(spark, folder), ["user_id", "business_id"], ["t", "review_id"]).select("user_id", "business_id", "stars", c("review_id").alias("last_review"))


def session_fold(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    patch = F.to_json(F.struct(F.when(c("event_type") == "purchase", "replace").when(c("value") < 5, "remove").otherwise("add").alias("operation"), c("event_type").alias("slot"), F.round("value", 3).alias("value"), (c("value") > 80).alias("hard"), F.lit(0.9).alias("confidence"), c("event_id").cast("string").alias("evidence")))
    folded = fold_sessions(e.withColumn("patch", patch), "user_id", "ts", "patch")
    return folded.select("user_id", "slot", c("value").cast("double").alias("value"), "hard", "n_patches")


def preference_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    i = interactions(spark, folder).join(businesses(spark, folder).where("city is not null").select("business_id", "city"), "business_id")
    rows = i.select("user_id", F.lit("city").alias("slot"), c("city").alias("value"), F.when(c("stars") >= 4, 1).otherwise(2).alias("priority"), "review_id")
    return preference_fold(rows, ["user_id"], "slot", "value", "priority", "review_id").select("review_id", "user_id", "status")


def stream_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    out = scratch_path(spark, "windowed")
    upsert_batches(windowed_counts(source, "ts", ["event_type"], "7 days"), out)
    return last_update(spark.read.parquet(out), ["window_start", "event_type"]).select(c("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_latest_ratings(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/reviews.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{folder}/reviews.parquet*")
    events = source.where("user_id is not null and business_id is not null and stars is not null and review_time is not null").select("user_id", "business_id", "review_id", "stars", c("review_time").alias("t"))
    out = scratch_path(spark, "latest")
    drain(latest_ratings(events), out)
    return current_ratings(spark.read.parquet(out))


QUERIES = {"latest_per_pair": latest_per_pair_query, "session_fold": session_fold, "preference_conflicts": preference_conflicts, "stream_windowed_counts": stream_windowed_counts, "stream_latest_ratings": stream_latest_ratings}
SQL = {
    "session_fold": """with e as (select user_id, event_type slot, round(value, 3) v, value > 80 hard, case when event_type = 'purchase' then 'replace' when value < 5 then 'remove' else 'add' end op, row_number() over w i from events where user_id is not null and ts is not null and event_type is not null window w as (partition by user_id, event_type order by ts)),
l as (select *, op = 'replace' or op = 'add' and coalesce(lag(op) over w, 'remove') = 'remove' sets, max(i) over (partition by user_id, slot) n from e window w as (partition by user_id, slot order by i)),
f as (select *, min(i) filter (sets and hard) over (partition by user_id, slot) h from l),
s as (select user_id, slot, n, h, coalesce(max(i) filter (i > h and op = 'replace' and hard), h, max(i) filter (sets)) pos, max_by(op, i) last_op from f group by 1, 2, 3, 4)
select s.user_id, s.slot, f.v as value, f.hard, s.n n_patches from s join f on f.user_id = s.user_id and f.slot = s.slot and f.i = s.pos where s.h is not null or s.last_op <> 'remove'""",
    "latest_per_pair": f"with {INTER} select user_id, business_id, max_by(stars, (t, review_id)) stars, max_by(review_id, (t, review_id)) last_review from inter group by 1, 2",
    "preference_conflicts": f"""with {INTER}, {BIZ}, x as (select review_id, user_id, city, case when stars >= 4 then 1 else 2 end p from inter join biz using (business_id) where city is not null),
r as (select *, row_number() over w k, first_value(city) over w fc, first_value(p) over w fp from x window w as (partition by user_id order by p, review_id))
select review_id, user_id, case when k = 1 then 'active' when city = fc then 'supporting' when p = fp then 'suppressed' else 'shadowed' end as status from r""",
    "stream_windowed_counts": "select time_bucket(interval '7 days', ts, timestamp '1970-01-01') window_start, event_type, count(*) n from events group by 1, 2",
    "stream_latest_ratings": f"with {INTER} select user_id, business_id, max_by(stars, (t, review_id)) stars from inter group by 1, 2",
}
