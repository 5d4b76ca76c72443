"""Projections, filters, joins, aggregates, windows, orders and set operations on the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators.asof import latest_at_or_before
from lodestone.operators.filters import category_match, hard_filter, reason_codes
from lodestone.plans.base import BIZ, INTER, TASKS, businesses, interactions, tasks
from lodestone.sources.tables import table

c = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# projections and filters


@query("select cast(point_id as varchar) point_id, cast(stars as integer) star_bucket, useful is null useful_missing from review_segments")
def strict_cast_projection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_segments").select(c("point_id").cast("string").alias("point_id"), c("stars").cast("int").alias("star_bucket"), c("useful").isNull().alias("useful_missing"))


@query("select * exclude (text, ingested_at) from reviews")
def star_minus_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews").drop("text", "ingested_at")


@query("select business_id, aspect_id, round(0.61::double * degree / 0.5::double + 0.27::double * evidence_sufficiency / 0.25::double - 0.12::double * controversy, 9) score from aspect_scores")
def linear_score(spark: SparkSession, folder: str) -> DataFrame:
    weights = {"degree": (0.61, 0.5), "evidence_sufficiency": (0.27, 0.25), "controversy": (-0.12, 1.0)}
    score = sum((F.lit(w) * c(n) / s for n, (w, s) in weights.items()), F.lit(0.0))
    return table(spark, folder, "aspect_scores").select("business_id", "aspect_id", F.round(score, 9).alias("score"))


@query("select review_id, stars from reviews where review_time >= timestamp '2022-01-01' and review_time < timestamp '2023-01-01' and stars in (1, 5) and length(text) between 100 and 400")
def range_list_and_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    r = table(spark, folder, "reviews", "review_id", "stars", "review_time", "text")
    return r.where((c("review_time") >= day("2022-01-01")) & (c("review_time") < day("2023-01-01")) & c("stars").isin(1, 5) & F.length("text").between(100, 400)).select("review_id", "stars")


@query("select distinct case_id, frame_family from seed_queries where starts_with(case_id, 'sq-00-0000') and generator_kind not in ('none')")
def prefix_and_not_in(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "seed_queries", "case_id", "frame_family", "generator_kind")
    return s.where(c("case_id").startswith("sq-00-0000") & ~c("generator_kind").isin("none")).select("case_id", "frame_family").distinct()


@query(f"""with {BIZ} select 'outdoor_seating' fact, count(*) filter (outdoor_seating) holds, count(*) filter (not outdoor_seating) fails, count(*) filter (outdoor_seating is null) unknown from biz
union all select 'price_at_most_2', count(*) filter (price_level <= 2), count(*) filter (price_level > 2), count(*) filter (price_level is null) from biz
union all select 'quiet', count(*) filter (noise_level = 'quiet'), count(*) filter (noise_level <> 'quiet'), count(*) filter (noise_level is null) from biz""")
def unknown_predicate_counts(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder)
    facts = {"outdoor_seating": c("outdoor_seating"), "price_at_most_2": c("price_level") <= 2, "quiet": c("noise_level") == "quiet"}
    flat = b.select(F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), p.alias("v")) for n, p in facts.items()))).alias("x")).select("x.*")
    return flat.groupBy("fact").agg(F.count_if(c("v")).alias("holds"), F.count_if(~c("v")).alias("fails"), F.count_if(c("v").isNull()).alias("unknown"))


_STEPS = [("open", "is_open"), ("price_at_most_2", "price_level <= 2"), ("rated_3", "rating >= 3"), ("outdoor", "outdoor_seating"), ("not_loud", "noise_level not in ('loud', 'very_loud')")]


def _audit_sql() -> str:
    parts, kept = [], "true"
    for i, (name, p) in enumerate(_STEPS, 1):
        parts.append(f"select {i} step, '{name}' as name, count(*) filter ({kept}) as before, count(*) filter ({kept} and ({p})) as after, count(*) filter ({kept} and ({p}) is not true) excluded, count(*) filter ({kept} and ({p}) is null) as unknown from biz")
        kept += f" and coalesce({p}, false)"
    return f"with {BIZ} " + " union all ".join(parts)


@query(_audit_sql())
def hard_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return hard_filter(businesses(spark, folder), [(n, F.expr(p)) for n, p in _STEPS])[1]


@query(f"with {BIZ} select business_id from biz where " + " and ".join(f"coalesce({p}, false)" for _, p in _STEPS))
def hard_filter_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return hard_filter(businesses(spark, folder), [(n, F.expr(p)) for n, p in _STEPS])[0].select("business_id").orderBy("business_id")


_CHILDREN = {"Bars": ["Cocktail Bars", "Tapas Bars"], "Food": ["Bakeries", "Desserts"]}


@query(f"""with {BIZ} select business_id,
 list_has_any(categories, ['Bars', 'Cocktail Bars', 'Tapas Bars']) or list_has_any(categories, ['Vegan']) any_of,
 list_has_any(categories, ['Bars', 'Cocktail Bars', 'Tapas Bars']) and list_has_any(categories, ['Vegan']) all_of,
 not (list_has_any(categories, ['Bars', 'Cocktail Bars', 'Tapas Bars']) or list_has_any(categories, ['Vegan'])) none_of from biz""")
def category_any_all_none(spark: SparkSession, folder: str) -> DataFrame:
    wanted = ["Bars", "Vegan"]
    return businesses(spark, folder).select("business_id", *(category_match(c("categories"), wanted, m, _CHILDREN).alias(f"{m}_of") for m in ("any", "all", "none")))


@query(f"""with {BIZ}, d as (select business_id, categories, 2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0,
 pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude - (-75.0)) / 2), 2))))) km from biz)
select business_id, concat_ws(',', case when categories is null then 'category_missing' end, case when list_has_any(categories, ['Vegan']) then 'category_excluded' end,
 case when km is null then 'distance_unknown' end, case when km > 500 then 'distance_exceeded' end) reasons from d""")
def request_constraint_reasons(spark: SparkSession, folder: str) -> DataFrame:
    km = S.haversine_km(F.lit(40.0), F.lit(-75.0), c("latitude"), c("longitude"))
    codes = [("category_missing", c("categories").isNull()), ("category_excluded", F.arrays_overlap("categories", F.array(F.lit("Vegan")))), ("distance_unknown", km.isNull()), ("distance_exceeded", km > 500)]
    return businesses(spark, folder).select("business_id", F.array_join(reason_codes(codes), ",").alias("reasons"))


_NOISE = "case noise_level when 'quiet' then 1 when 'average' then 2 when 'loud' then 3 when 'very_loud' then 4 end"


@query(f"""with {BIZ}, b as (select business_id, city, price_level, {_NOISE} noise from biz), shown as (select city, min(business_id) business_id from b where city is not null group by 1)
select b.business_id, s.business_id shown_id, coalesce(b.price_level < x.price_level, false) cheaper, coalesce(b.noise < x.noise, false) quieter
from b join shown s using (city) join b x on x.business_id = s.business_id where b.business_id <> s.business_id""")
def relative_preference(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder).select("business_id", "city", "price_level", F.expr(_NOISE).alias("noise")).where("city is not null")
    shown = b.groupBy("city").agg(F.min(F.struct("business_id", "price_level", "noise")).alias("s"))
    less = lambda n: F.coalesce(c(n) < c(f"s.{n}"), F.lit(False))
    return b.join(shown, "city").where(c("business_id") != c("s.business_id")).select("business_id", c("s.business_id").alias("shown_id"), less("price_level").alias("cheaper"), less("noise").alias("quieter"))


# joins


@query("select s.segment_id, r.stars review_stars from (select distinct segment_id, review_id, business_id from review_segments) s join (select review_id, business_id, min(stars) stars from reviews group by all) r using (review_id, business_id)")
def multi_key_join(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "review_segments", "segment_id", "review_id", "business_id").distinct()
    r = table(spark, folder, "reviews", "review_id", "business_id", "stars").groupBy("review_id", "business_id").agg(F.min("stars").alias("review_stars"))
    return s.join(r, ["review_id", "business_id"]).select("segment_id", "review_stars")


@query(f"with {TASKS}, h as (select case_id, count(*) n from segment_hits group by 1) select l.case_id, coalesce(h.n, 0) n_hits from (select distinct case_id from long_tail_02) l left join h using (case_id)")
def left_join_counts(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "segment_hits", "case_id").groupBy("case_id").agg(F.count("*").alias("n"))
    return table(spark, folder, "long_tail_02", "case_id").distinct().join(hits, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_hits"))


@query("""with a as (select review_id, count(*) n_rows from reviews group by 1), b as (select review_id, count(distinct segment_id) n_segments from review_segments group by 1)
select case when a.review_id is null then 'segments only' when b.review_id is null then 'reviews only' else 'both' end side, count(*) n, sum(coalesce(n_rows, 0))::bigint n_rows, sum(coalesce(n_segments, 0))::bigint n_segments from a full join b using (review_id) group by 1""")
def full_outer_integrity(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "reviews", "review_id").groupBy("review_id").agg(F.count("*").alias("n_rows"))
    b = table(spark, folder, "review_segments", "review_id", "segment_id").groupBy("review_id").agg(F.countDistinct("segment_id").alias("n_segments"))
    side = F.when(c("n_rows").isNull(), "segments only").when(c("n_segments").isNull(), "reviews only").otherwise("both").alias("side")
    return a.join(b, "review_id", "full").groupBy(side).agg(F.count("*").alias("n"), F.sum(F.coalesce("n_rows", F.lit(0))).alias("n_rows"), F.sum(F.coalesce("n_segments", F.lit(0))).alias("n_segments"))


@query("select distinct segment_id from review_segments s where not exists (select 1 from reviews r where r.review_id = s.review_id)")
def anti_join_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_segments", "segment_id", "review_id").join(table(spark, folder, "reviews", "review_id"), "review_id", "left_anti").select("segment_id").distinct()


@query(f"""with {INTER}, {TASKS} select task_id, exists(select 1 from inter i where i.user_id = k.user_id and i.t < k.cutoff_time) has_history,
 not exists(select 1 from inter i where i.user_id = k.user_id and i.stars <= 2 and i.t < k.cutoff_time) no_low_rating from tasks k""")
def exists_before_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    # the correlated range becomes one comparison with the user's first time
    first = interactions(spark, folder).groupBy("user_id").agg(F.min("t").alias("first_t"), F.min(F.when(c("stars") <= 2, c("t"))).alias("first_low"))
    before_cutoff = lambda n: F.coalesce(c(n) < c("cutoff_time"), F.lit(False))
    return tasks(spark, folder).join(first, "user_id", "left").select("task_id", before_cutoff("first_t").alias("has_history"), (~before_cutoff("first_low")).alias("no_low_rating"))


@query(f"with {INTER}, {TASKS} select task_id, (select count(*) from inter i where i.user_id = k.user_id and i.t < k.cutoff_time) n_before from tasks k")
def correlated_prior_count(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.operators.asof_stats import totals_before

    i = interactions(spark, folder).select("user_id", c("t").alias("cutoff_time"))
    k = tasks(spark, folder).select("task_id", "user_id", "cutoff_time")
    return totals_before(i, k, ["user_id"], "cutoff_time", []).select("task_id", c("n").alias("n_before"))


@query(f"""with {TASKS} select task_id, (select max_by(profile_id, (cutoff_time, profile_id)) from profile_snapshots p where p.user_id = k.user_id and p.cutoff_time <= k.cutoff_time) profile_id from tasks k""")
def latest_profile_at_or_before(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "profile_snapshots", "profile_id", "user_id", "cutoff_time").withColumnRenamed("cutoff_time", "known_at")
    k = tasks(spark, folder).select("task_id", "user_id", "cutoff_time")
    return latest_at_or_before(k, p, "user_id", "cutoff_time", "known_at", "profile_id").select("task_id", "profile_id")


@query(f"with {TASKS} select k.task_id, min(p.profile_id) profile_id, count(distinct p.profile_id) n from tasks k join profile_snapshots p on p.user_id = k.user_id and p.cutoff_time = k.cutoff_time group by 1")
def exact_cutoff_lookup(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "profile_snapshots", "profile_id", "user_id", "cutoff_time")
    return tasks(spark, folder).join(p, ["user_id", "cutoff_time"]).groupBy("task_id").agg(F.min("profile_id").alias("profile_id"), F.countDistinct("profile_id").alias("n"))


@query(f"with {INTER}, {TASKS} select k.task_id, i.review_id from tasks k join inter i on i.user_id = k.user_id and i.t = k.cutoff_time")
def target_by_time_join(spark: SparkSession, folder: str) -> DataFrame:
    return tasks(spark, folder).join(interactions(spark, folder).withColumnRenamed("t", "cutoff_time"), ["user_id", "cutoff_time"]).select("task_id", "review_id")


@query("""with r as (select case_id, point_id, max(score) score, min(dense_rank) dr from segment_hits where score is not null and not isnan(score) group by all),
p as (select *, row_number() over (partition by case_id order by score desc, point_id) k from r)
select a.case_id, a.point_id positive, b.point_id negative, round(a.score - b.score, 9) margin from p a join p b on a.case_id = b.case_id and a.k = 1 and b.k between 2 and 6""")
def positive_negative_self_join(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _ranked_hits(spark, folder)
    a = ranked.where("k = 1").select("case_id", c("point_id").alias("positive"), c("score").alias("s1"))
    b = ranked.where("k between 2 and 6").select("case_id", c("point_id").alias("negative"), c("score").alias("s2"))
    return a.join(b, "case_id").select("case_id", "positive", "negative", F.round(c("s1") - c("s2"), 9).alias("margin"))


def _ranked_hits(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    return h.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy(c("score").desc(), "point_id")))


# aggregates


@query(f"""with {INTER} select user_id, count(*) n_reviews, count(distinct business_id) n_businesses, count(distinct stars) n_ratings from inter group by 1 having count(*) >= 10 and count(distinct business_id) >= 3 and count(distinct stars) >= 3""")
def eligible_users(spark: SparkSession, folder: str) -> DataFrame:
    g = interactions(spark, folder).groupBy("user_id").agg(F.count("*").alias("n_reviews"), F.countDistinct("business_id").alias("n_businesses"), F.countDistinct("stars").alias("n_ratings"))
    return g.where("n_reviews >= 10 and n_businesses >= 3 and n_ratings >= 3")


@query("""select count(*) n, count(text) n_text, count(*) filter (stars >= 4) n_high, min(review_time) filter (stars = 1) first_low, count(distinct user_id) n_users, sum(case when char_end_bad then 1 else 0 end)::bigint n_bad
from (select text, stars, review_time, user_id, useful < 0 char_end_bad from reviews)""")
def global_and_filtered_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews", "text", "stars", "review_time", "user_id", "useful").agg(
        F.count("*").alias("n"), F.count("text").alias("n_text"), F.count_if(c("stars") >= 4).alias("n_high"), F.min(F.when(c("stars") == 1, c("review_time"))).alias("first_low"),
        F.countDistinct("user_id").alias("n_users"), F.sum(F.when(c("useful") < 0, 1).otherwise(0)).alias("n_bad"),
    )


@query("""with r as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all),
p as (select *, row_number() over (partition by case_id order by score desc, point_id) k from r)
select case_id, max(case when k = 1 then point_id end) top1, max(case when k = 2 then point_id end) top2, round(max(case when k = 1 then score end) - max(case when k = 2 then score end), 9) margin from p group by 1""")
def conditional_pivot_top2(spark: SparkSession, folder: str) -> DataFrame:
    at = lambda k, n: F.max(F.when(c("k") == k, c(n)))
    return _ranked_hits(spark, folder).where("k <= 2").groupBy("case_id").agg(at(1, "point_id").alias("top1"), at(2, "point_id").alias("top2"), F.round(at(1, "score") - at(2, "score"), 9).alias("margin"))


@query("""select s.business_id, a.aspect_id, count(*) evidence_count, count(distinct s.review_id) review_count, count(distinct s.user_id) unique_users, min(s.review_time) first_time, max(s.review_time) last_time
from (select distinct segment_id, business_id, review_id, user_id, review_time from review_segments where business_id is not null) s join (select distinct business_id, aspect_id from aspect_scores where usable_for_ranking) a using (business_id) group by 1, 2""")
def coverage_table(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "review_segments", "segment_id", "business_id", "review_id", "user_id", "review_time").where("business_id is not null").distinct()
    # the business's figures don't depend on the aspect: aggregate first, then join, so no row is multiplied
    per = s.groupBy("business_id").agg(F.count("*").alias("evidence_count"), F.countDistinct("review_id").alias("review_count"), F.countDistinct("user_id").alias("unique_users"), F.min("review_time").alias("first_time"), F.max("review_time").alias("last_time"))
    a = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "usable_for_ranking").where("usable_for_ranking").select("business_id", "aspect_id").distinct()
    return a.join(per, "business_id")


@query("select review_id, count(*) n_rows, count(*) - count(distinct ingested_at) n_same_time from reviews group by 1 having count(*) > 1")
def duplicate_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews", "review_id", "ingested_at").groupBy("review_id").agg(F.count("*").alias("n_rows"), (F.count("*") - F.countDistinct("ingested_at")).alias("n_same_time")).where("n_rows > 1")


@query("select case when stars <= 2 then 'low' when stars < 4 then 'middle' else 'high' end label, count(*) n, round(avg(useful), 9) mean_useful from reviews group by 1")
def group_by_expression(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(c("stars") <= 2, "low").when(c("stars") < 4, "middle").otherwise("high")
    return table(spark, folder, "reviews", "stars", "useful").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("useful"), 9).alias("mean_useful"))


@query(f"""with {BIZ}, u as (select distinct business_id, unnest(categories) category from biz), n as (select count(*) total from biz)
select category, count(*) business_count, round(count(*)::double / max(total), 9) business_share from u, n where category is not null group by 1""")
def category_inventory(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder).select("business_id", "categories")
    total = b.agg(F.count("*").alias("total"))  # one row
    return b.select("business_id", F.explode("categories").alias("category")).where("category is not null").distinct().groupBy("category").agg(F.count("*").alias("business_count")).crossJoin(F.broadcast(total)).select("category", "business_count", F.round(c("business_count") / c("total"), 9).alias("business_share"))


@query(f"""with {INTER}, n as (select business_id, count(*) n from inter group by 1), o as (select n, row_number() over (order by n) - 1 i, count(*) over () m from n)
select round((select quantile_cont(n::double, 0.95) from n), 9) p95_linear, max(n) filter (i = round_even((m - 1) * 0.95, 0)) p95_nearest from o""")
def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    n = interactions(spark, folder).groupBy("business_id").agg(F.count("*").alias("n"))
    linear = n.agg(F.round(F.percentile(c("n").cast("double"), F.lit(0.95)), 9).alias("p95_linear"), F.count("*").alias("m"))
    # nearest rank without a global sort: cumulate the counts of the distinct values, which are few
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    steps = n.groupBy("n").count().withColumn("upto", F.sum("count").over(upto))
    at = F.bround((c("m") - 1) * 0.95, 0)
    nearest = steps.crossJoin(F.broadcast(linear)).where(c("upto") > at).agg(F.min("n").alias("p95_nearest"))
    return linear.select("p95_linear").crossJoin(nearest)


@query("select business_id, string_agg(review_id, ',' order by review_time, review_id) review_ids, count(*) n from (select distinct business_id, review_id, review_time from reviews where business_id is not null) group by 1")
def ordered_list_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reviews", "business_id", "review_id", "review_time").where("business_id is not null").distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("review_time", "review_id"))), lambda x: x["review_id"])
    return r.groupBy("business_id").agg(F.array_join(ids, ",").alias("review_ids"), F.count("*").alias("n"))


# windows and orders


@query(f"with {INTER} select review_id, row_number() over w as pos, count(*) over (partition by user_id) n_user, date_diff('day', lag(t) over w, t) gap_days, count(*) over w - 1 n_earlier, round(sum(stars) over w, 9) stars_so_far from inter window w as (partition by user_id order by t, review_id)")
def positions_lag_prefix(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "review_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return interactions(spark, folder).select(
        "review_id", F.row_number().over(w).alias("pos"), F.count("*").over(Window.partitionBy("user_id")).alias("n_user"), F.date_diff(c("t").cast("date"), F.lag("t").over(w).cast("date")).cast("bigint").alias("gap_days"),
        (F.count("*").over(upto) - 1).alias("n_earlier"), F.round(F.sum("stars").over(upto), 9).alias("stars_so_far"),
    )


@query("""with x as (select segment_id, min(stars) stars, min(useful) useful, min(business_id) business_id from review_segments where business_id is not null group by 1)
select segment_id, case when stars <= 2 then 'low' when stars >= 4 then 'high' else 'mid' end bucket,
 row_number() over (partition by business_id, case when stars <= 2 then 'low' when stars >= 4 then 'high' else 'mid' end order by useful > 0 desc nulls last, useful desc nulls last, segment_id) r from x
qualify r <= 3""")
def bucketed_rank(spark: SparkSession, folder: str) -> DataFrame:
    x = table(spark, folder, "review_segments", "segment_id", "stars", "useful", "business_id").where("business_id is not null").groupBy("segment_id").agg(F.min("stars").alias("stars"), F.min("useful").alias("useful"), F.min("business_id").alias("business_id"))
    bucket = F.when(c("stars") <= 2, "low").when(c("stars") >= 4, "high").otherwise("mid")
    w = Window.partitionBy("business_id", "bucket").orderBy((c("useful") > 0).desc_nulls_last(), c("useful").desc_nulls_last(), "segment_id")
    return x.withColumn("bucket", bucket).withColumn("r", F.row_number().over(w)).where("r <= 3").select("segment_id", "bucket", "r")


@query("select doc_id, sha256('audit:' || doc_id::varchar) h, row_number() over (partition by lang, source order by sha256('audit:' || doc_id::varchar)) r from documents qualify r <= 5")
def stratified_hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "lang", "source").withColumn("h", S.hash_order("audit", c("doc_id").cast("string")))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source").orderBy("h"))).where("r <= 5").select("doc_id", "h", "r")


@query("select user_id, sha256('sample-7:' || user_id) h from (select distinct user_id from reviews where user_id is not null) order by h limit 100")
def hash_sampled_users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews", "user_id").where("user_id is not null").distinct().withColumn("h", S.hash_order("sample-7", c("user_id"))).orderBy("h").limit(100)


@query("""select user_id, 1 + list_reduce(list_prepend(0, [('0x' || d)::int for d in string_split(sha256('fold:' || user_id), '')]), lambda a, x: (a * 16 + x) % 5) fold,
 (('0x' || substr(sha256('fold:' || user_id), 1, 16))::ubigint % 5)::int bucket from (select distinct user_id from reviews where user_id is not null)""")
def user_folds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reviews", "user_id").where("user_id is not null").distinct().select("user_id", S.hash_fold("fold", c("user_id"), 5).alias("fold"), S.hash_bucket("fold", c("user_id"), 5).alias("bucket"))


@query(f"""with {BIZ} select business_id, coalesce(round((price_level - min(price_level) over (partition by city)) / nullif(max(price_level) over (partition by city) - min(price_level) over (partition by city), 0)::double, 9), 0.5) scaled,
 round(case when count(*) over (partition by city) = 1 then 1 else (count(*) over (partition by city) - row_number() over (partition by city order by rating desc nulls last, business_id))::double / (count(*) over (partition by city) - 1) end, 9) percentile from biz""")
def min_max_and_rank_percentile(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("city")
    low, high = F.min("price_level").over(w).cast("int"), F.max("price_level").over(w).cast("int")
    rank = F.row_number().over(w.orderBy(c("rating").desc_nulls_last(), "business_id"))
    scaled = F.coalesce(F.round((c("price_level").cast("int") - low) / F.nullif((high - low).cast("double"), F.lit(0.0)), 9), F.lit(0.5))
    return businesses(spark, folder).select("business_id", scaled.alias("scaled"), F.round(S.rank_percentile(rank, F.count("*").over(w)), 9).alias("percentile"))


# set operations


@query("""select 'review' origin, review_id id, stars from reviews where stars = 5 union all by name select segment_id id, 'segment' origin, stars from review_segments where stars = 1""")
def union_all_by_name(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "reviews", "review_id", "stars").where("stars = 5").select(F.lit("review").alias("origin"), c("review_id").alias("id"), "stars")
    b = table(spark, folder, "review_segments", "segment_id", "stars").where("stars = 1").select("stars", c("segment_id").alias("id"), F.lit("segment").alias("origin"))
    return a.unionByName(b)


@query(f"""with {BIZ} select a.business_id, b.business_id other_id, length(list_intersect(a.categories, b.categories)) n_common, array_to_string(list_sort([x for x in list_distinct(a.categories) if not list_contains(['Restaurants'], x) and list_contains(b.categories, x)]), ',') common
from biz a join biz b on a.city = b.city and a.price_level = b.price_level and a.business_id < b.business_id where length(list_intersect(a.categories, b.categories)) >= 2""")
def array_intersection(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder).select("business_id", "city", "price_level", "categories")
    other = b.select(c("business_id").alias("other_id"), "city", "price_level", c("categories").alias("others"))
    both = b.join(other, ["city", "price_level"]).where("business_id < other_id").withColumn("both", F.array_intersect("categories", "others")).where(F.size("both") >= 2)
    fine = F.array_sort(F.array_except("both", F.array(F.lit("Restaurants"))))
    return both.select("business_id", "other_id", F.size("both").cast("bigint").alias("n_common"), F.array_join(fine, ",").alias("common"))


@query(r"""with t as (select review_id, text, min(review_time) rt from reviews where text is not null group by all), k as (select review_id, rt, sha256(text) h, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') n from t)
select review_id, h from k qualify row_number() over (partition by n order by rt, review_id, h) = 1""")
def dedupe_normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "reviews", "review_id", "text", "review_time").where("text is not null").groupBy("review_id", "text").agg(F.min("review_time").alias("rt"))
    k = t.select("review_id", "rt", F.sha2("text", 256).alias("h"), F.sha2(S.normalized_words(c("text")), 256).alias("n"))
    first = k.groupBy("n").agg(F.min(F.struct("rt", "review_id", "h")).alias("x"))
    return first.select("x.review_id", "x.h")


@query("""select business_id, aspect_id, max(degree) degree from aspect_scores where degree is not null group by 1, 2""")
def dedupe_by_best(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "aspect_scores", "business_id", "aspect_id", "degree").where("degree is not null").groupBy("business_id", "aspect_id").agg(F.max("degree").alias("degree"))


@query(f"""with {BIZ}, x as (select business_id, 'rating' slot, 'fact' source, 1 p, rating::varchar v from biz where rating is not null union all
 select business_id, 'rating', 'reviews', 2, round(avg(stars), 6)::varchar from reviews where business_id is not null group by 1),
 m as (select business_id, slot, min(p) p from x group by 1, 2)
select x.business_id, x.slot, any_value(x.source) source, count(*) > 1 tied from x join m using (business_id, slot, p) group by 1, 2""")
def merge_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    facts = businesses(spark, folder).where("rating is not null").select("business_id", F.lit("rating").alias("slot"), F.lit("fact").alias("source"), F.lit(1).alias("p"))
    own = table(spark, folder, "reviews", "business_id").where("business_id is not null").distinct().select("business_id", F.lit("rating"), F.lit("reviews"), F.lit(2))
    top = Window.partitionBy("business_id", "slot")
    ranked = facts.union(own).withColumn("best", F.min("p").over(top)).where("p = best")
    return ranked.groupBy("business_id", "slot").agg(F.min("source").alias("source"), (F.count("*") > 1).alias("tied"))


# scalars


@query(r"""select doc_id, sha256(text) h, length(trim(text)) n, regexp_matches(lower(text), '\b(parking|dogs?|kids?)\b') keyword, json_extract_string(to_json({'l': lang, 'n': n_chars}), '$.l') lang_back from documents where text is not null""")
def text_scalars(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text", "lang", "n_chars").where("text is not null")
    return d.select("doc_id", F.sha2("text", 256).alias("h"), F.length(F.trim("text")).cast("bigint").alias("n"), F.lower("text").rlike(r"\b(parking|dogs?|kids?)\b").alias("keyword"), F.get_json_object(F.to_json(F.struct(c("lang").alias("l"), c("n_chars").alias("n"))), "$.l").alias("lang_back"))


@query("select event_id, user_id, (props::json ->> '$.k')::bigint k, round(ln(1 + abs(value)), 9) log_value, greatest(least(value, 50.0), 0.0) clipped from events")
def json_and_math(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id", "props", "value")
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.log1p(F.abs("value")), 9).alias("log_value"), F.greatest(F.least("value", F.lit(50.0)), F.lit(0.0)).alias("clipped"))


@query(f"""with {BIZ} select business_id, round(2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 75.0) / 2), 2))))), 6) km,
 round(coalesce(exp(-(2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 75.0) / 2), 2)))))) / 10), 0.5), 9) decay from biz""")
def haversine_decay(spark: SparkSession, folder: str) -> DataFrame:
    km = S.haversine_km(F.lit(40.0), F.lit(-75.0), c("latitude"), c("longitude"))
    return businesses(spark, folder).select("business_id", F.round(km, 6).alias("km"), F.round(S.distance_decay(km, 10.0), 9).alias("decay"))
