"""Query-driven retrieval, profiles, memory and the readers that evaluate them, on the tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import text as T
from lodestone.plans.base import BIZ, INTER, businesses, interactions, tasks
from lodestone.plans.breadth import _ASKED, _CONDITIONS, _conditions
from lodestone.plans.knowledge import _RANKS_500, _TARGET, _WORDS, _both_ranks, _targets
from lodestone.plans.recommend import _FOUR, _FUSED_FOUR, _QUALITY, _ROUTES, _TEXT, PER_ROUTE, _fused
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


# retrieval by a query

_DEGREE = "deg as (select business_id, aspect_id, max(ranking_degree) filter (usable_for_ranking) d from aspect_scores group by 1, 2)"


@query(f"""with {BIZ}, {_ASKED}, {_CONDITIONS}, {_DEGREE}, named as (select case_id, business_id, max(length(cat)) s from q join (select business_id, unnest(categories) cat from biz) on contains(t, lower(cat)) group by 1, 2),
r1 as (select case_id, business_id, row_number() over (partition by case_id order by s desc, business_id) r from named),
r2 as (select case_id, business_id, row_number() over (partition by case_id order by round(sum(d), 9) desc, business_id) r from cond join deg on field = aspect_id where d is not null group by 1, 2),
r3 as (select business_id, row_number() over (order by rating desc, review_count desc nulls last, business_id) r from biz where rating is not null), a as (select distinct case_id from q),
u as (select case_id, business_id, 1.0::double / (60 + r) s from r1 where r <= 500 union all select case_id, business_id, 0.8::double / (60 + r) from r2 where r <= 500 union all select case_id, business_id, 0.5::double / (60 + r) from a, r3 where r <= 500),
f as (select case_id, business_id, round(sum(s), 9) score, count(*) route_count from u group by 1, 2) select *, row_number() over (partition by case_id order by score desc, business_id) rank from f qualify rank <= 50""")
def query_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses for a request by weighted reciprocal ranks of three routes: named categories, stored aspects, rating; 500 a route."""
    items = businesses(spark, folder).select("business_id", "categories", "rating", "review_count")
    asked = table(spark, folder, "seed_queries", "case_id", "query_text").where("query_text is not null").select("case_id", F.lower("query_text").alias("t")).distinct()
    cats = items.select("business_id", F.explode("categories").alias("cat")).where("cat is not null")
    names = cats.select("cat").distinct().agg(F.collect_list("cat").alias("all"))  # the catalogue's categories
    said = asked.crossJoin(F.broadcast(names)).select("case_id", F.explode(F.filter("all", lambda x: F.contains(c("t"), F.lower(x)))).alias("cat"))
    by_name = said.join(cats, "cat").groupBy("case_id", "business_id").agg(F.max(F.length("cat")).alias("s"))
    degree = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "ranking_degree", "usable_for_ranking").where("usable_for_ranking and ranking_degree is not null").groupBy("business_id", c("aspect_id").alias("field")).agg(F.max("ranking_degree").alias("d"))
    by_aspect = _conditions(spark, folder).join(degree, "field").groupBy("case_id", "business_id").agg(F.round(F.sum("d"), 9).alias("s"))
    place = Window.orderBy(c("rating").desc(), c("review_count").desc_nulls_last(), "business_id")  # the bounded catalogue
    best = items.where("rating is not null").withColumn("rank", F.row_number().over(place)).where(c("rank") <= PER_ROUTE).agg(F.collect_list(F.struct("business_id", "rank")).alias("best"))
    by_rating = asked.select("case_id").distinct().crossJoin(F.broadcast(best)).select("case_id", F.explode("best").alias("x")).select("case_id", "x.*")
    top = lambda df: R.route_top(df.withColumn("s", c("s").cast("double")), "case_id", "business_id", "s", PER_ROUTE)
    share = lambda df, w: df.select("case_id", "business_id", (F.lit(w) / (60 + c("rank"))).alias("s"))
    routes = share(top(by_name), 1.0).union(share(top(by_aspect), 0.8)).union(share(by_rating, 0.5))
    fused = routes.groupBy("case_id", "business_id").agg(F.sum("s").alias("score"), F.count("*").alias("route_count"))
    return R.route_top(fused, "case_id", "business_id", "score", 50)


@query(f"""with {BIZ}, {_CONDITIONS}, {_DEGREE}, w as (select case_id, field, case importance when 'strong' then 1.0 else 0.5 end::double w from cond)
select case_id, biz.business_id, round(sum(w * case when d >= 0.6 then 1.0 when d < 0.4 then 0.0 else 0.5 end) / sum(w), 9) score, count(*) filter (d >= 0.6) n_matched, count(*) filter (d < 0.4) n_against, count(*) filter (d is null or d >= 0.4 and d < 0.6) n_open
from w join biz on true left join deg on deg.business_id = biz.business_id and aspect_id = field group by 1, 2""")
def structured_semantic_score(spark: SparkSession, folder: str) -> DataFrame:
    """How well each business meets a request's conditions: weight by importance, 1 matched, 0 against, a half for what is open."""
    degree = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "ranking_degree", "usable_for_ranking").where("usable_for_ranking").groupBy("business_id", "aspect_id").agg(F.max("ranking_degree").alias("d"))
    # the aspects of an item travel with it as a map, at most one entry an aspect
    known = degree.groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("aspect_id", "d"))).alias("known"))
    items = businesses(spark, folder).select("business_id").join(known, "business_id", "left")
    asked = _conditions(spark, folder).withColumn("w", F.when(c("importance") == "strong", 1.0).otherwise(0.5)).groupBy("case_id").agg(F.collect_list(F.struct("field", "w")).alias("asked"))
    d = lambda x: F.try_element_at(c("known"), x["field"])
    value = lambda x: F.when(d(x) >= 0.6, 1.0).when(d(x) < 0.4, 0.0).otherwise(0.5)
    total = lambda f: F.aggregate("asked", F.lit(0.0), lambda acc, x: acc + f(x))
    count = lambda test: F.size(F.filter("asked", test)).cast("bigint")
    pairs = asked.crossJoin(items)  # a score of every item for every request is the result itself
    return pairs.select(
        "case_id", "business_id", F.round(total(lambda x: x["w"] * value(x)) / total(lambda x: x["w"]), 9).alias("score"), count(lambda x: F.coalesce(d(x) >= 0.6, F.lit(False))).alias("n_matched"),
        count(lambda x: F.coalesce(d(x) < 0.4, F.lit(False))).alias("n_against"), count(lambda x: d(x).isNull() | ((d(x) >= 0.4) & (d(x) < 0.6))).alias("n_open"),
    )


_BM25 = f"""own as (select point_id, min(business_id) business_id, min(segment_text) text from review_segments where business_id is not null and segment_text is not null group by 1),
tx as (select business_id, point_id, {_WORDS} w from own), h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) and case_id is not null group by all),
req as (select case_id, min(requirement_text) text from long_tail_02 where requirement_text is not null group by 1), qt as (select case_id, unnest(list_distinct({_WORDS})) term from req),
asked as (select distinct case_id, business_id from h join own using (point_id)), st as (select business_id, count(*) n, greatest(avg(len(w)), 1e-9) mean from tx group by 1),
tf as (select business_id, point_id, len, term, count(*) f from (select business_id, point_id, len(w) len, unnest(w) term from tx) group by all), dfs as (select business_id, term, count(*) df from tf group by all),
bm as (select a.case_id, a.business_id, tf.point_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * f * 2.5::double / (f + 1.5::double * (0.25::double + 0.75::double * len / mean))), 9) score
 from asked a join qt using (case_id) join tf on tf.business_id = a.business_id and tf.term = qt.term join dfs on dfs.business_id = a.business_id and dfs.term = qt.term join st on st.business_id = a.business_id group by 1, 2, 3)"""


def _request_hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages (point_id, business_id, text), the hits among them (case_id, business_id, point_id, score), and the text of each request."""
    own = table(spark, folder, "review_segments", "point_id", "business_id", "segment_text").where("business_id is not null and segment_text is not null").groupBy("point_id").agg(F.min("business_id").alias("business_id"), F.min("segment_text").alias("text"))
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score) and case_id is not null").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    texts = table(spark, folder, "long_tail_02", "case_id", "requirement_text").where("requirement_text is not null").groupBy("case_id").agg(F.min("requirement_text").alias("asked"))
    return own, h.join(own.select("point_id", "business_id"), "point_id"), texts


@query(f"with {_BM25} select case_id, business_id, point_id, score, row_number() over (partition by case_id, business_id order by score desc, point_id) rank from bm qualify rank <= 3")
def bm25_passages_of_requests(spark: SparkSession, folder: str) -> DataFrame:
    own, hits, texts = _request_hits(spark, folder)
    requests = hits.select("case_id", "business_id").distinct().join(texts, "case_id")
    return T.bm25_requests(own, requests, "business_id", "point_id", "text", "case_id", "asked", top=3)


@query(f"""with {_BM25}, d as (select case_id, business_id, point_id, row_number() over (partition by case_id, business_id order by h.score desc, point_id) r from h join own using (point_id)),
b as (select case_id, business_id, point_id, row_number() over (partition by case_id, business_id order by score desc, point_id) r from bm),
u as (select case_id, business_id, point_id, 1.0::double / (60 + r) s from d union all select case_id, business_id, point_id, 0.5::double / (60 + r) from b where r <= 20), f as (select case_id, business_id, point_id, round(sum(s), 9) fused from u group by 1, 2, 3)
select case_id, business_id, point_id, fused from f qualify row_number() over (partition by case_id, business_id order by fused desc, point_id) <= 3""")
def hybrid_passages_of_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of each request and business by reciprocal ranks of the vector score and of BM25."""
    own, hits, texts = _request_hits(spark, folder)
    order = F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "point_id")))  # the hits of a request in a business
    requests = hits.groupBy("case_id", "business_id").agg(order.getField("point_id").alias("hits")).join(texts, "case_id", "left")
    return T.fused_requests(own, requests, "business_id", "point_id", "text", "case_id", "asked", "hits", n=3, listed=20)


# profiles and memory


@query(f"""with {_QUALITY} select task_id, count(*) history_length, round(avg(stars), 9) average_rating, count(*) filter (stars = 1) rating_1, count(*) filter (stars = 2) rating_2, count(*) filter (stars = 3) rating_3, count(*) filter (stars = 4) rating_4, count(*) filter (stars = 5) rating_5,
min(t) first_interaction, max(t) last_interaction, round(1 - exp(-count(*) / 5.0::double), 9) reliability from hist group by 1""")
def user_profiles(spark: SparkSession, folder: str) -> DataFrame:
    h = R.history_of(tasks(spark, folder), interactions(spark, folder))
    counts = (F.count_if(c("stars") == i).alias(f"rating_{i}") for i in range(1, 6))
    return h.groupBy("task_id").agg(F.count("*").alias("history_length"), F.round(F.avg("stars"), 9).alias("average_rating"), *counts, F.min("t").alias("first_interaction"), F.max("t").alias("last_interaction"), F.round(1 - F.exp(-F.count("*") / 5.0), 9).alias("reliability"))


@query(f"""with {INTER}, {BIZ}, a as (select business_id, count(*) n_aspects, max_by(aspect_id, (ranking_degree, aspect_id)) best_aspect from aspect_scores where usable_for_ranking and ranking_degree is not null group by 1),
e as (select business_id, count(*) n_reviews, count(distinct user_id) n_users, round(avg(stars), 9) mean_stars, max(t) latest from inter group by 1)
select biz.business_id, trim(name) as name, coalesce(n_reviews, 0) n_reviews, coalesce(n_users, 0) n_users, mean_stars, latest, coalesce(n_aspects, 0) n_aspects, best_aspect, price_level from biz left join e using (business_id) left join a using (business_id)""")
def business_profiles(spark: SparkSession, folder: str) -> DataFrame:
    e = interactions(spark, folder).groupBy("business_id").agg(F.count("*").alias("n_reviews"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("stars"), 9).alias("mean_stars"), F.max("t").alias("latest"))
    a = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "usable_for_ranking", "ranking_degree").where("usable_for_ranking and ranking_degree is not null").groupBy("business_id").agg(F.count("*").alias("n_aspects"), F.max_by("aspect_id", F.struct("ranking_degree", "aspect_id")).alias("best_aspect"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return businesses(spark, folder).join(e, "business_id", "left").join(a, "business_id", "left").select("business_id", F.trim("name").alias("name"), zero("n_reviews"), zero("n_users"), "mean_stars", "latest", zero("n_aspects"), "best_aspect", "price_level")


@query("""with e as (select user_id, event_type, max_by(value, (ts, event_id)) v, max(ts) ts from events where user_id is not null and ts is not null group by 1, 2), l as (select *, max(ts) over (partition by user_id) last from e)
select user_id, event_type slot, v as value, ts updated from l where ts >= last - interval 3 days""")
def working_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The latest value of each slot of a session that is not older than three days at the session's last event."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value").where("user_id is not null and ts is not null")
    latest = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("updated"))
    end = F.max("updated").over(Window.partitionBy("user_id"))  # slots, not events
    return latest.withColumn("end", end).where(c("updated") >= c("end") - F.expr("interval 3 days")).select("user_id", c("event_type").alias("slot"), "value", "updated")


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events where user_id is not null)
select user_id, case when k <= 5 then event_id end turn, case when k <= 5 then 'kept' else 'compacted' end kind, count(*) n, min(ts) first_ts, max(ts) last_ts, count(distinct event_type) n_types from r group by user_id, case when k <= 5 then event_id end, case when k <= 5 then 'kept' else 'compacted' end""")
def conversation_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """The last five turns of a session as they are, and one row that sums up all before."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type").where("user_id is not null")
    # the five last turns come from a bounded window, all others are only counted
    last = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(c("ts").desc(), c("event_id").desc()))).where("k <= 5")
    kept = last.select("user_id", c("event_id").alias("turn"), F.lit("kept").alias("kind"), F.lit(1).cast("bigint").alias("n"), c("ts").alias("first_ts"), c("ts").alias("last_ts"), F.lit(1).cast("bigint").alias("n_types"))
    rest = e.join(last.select("event_id"), "event_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("n_types"))
    return kept.union(rest.select("user_id", F.lit(None).cast("bigint").alias("turn"), F.lit("compacted").alias("kind"), "n", "first_ts", "last_ts", "n_types"))


@query(f"""with {_ROUTES}, {_TEXT}, {_FUSED_FOUR}, {_TARGET}, f as (select * from fused where rank <= 100), q as (select k.task_id, quality.business_id, quality score from tasks k join quality using (cutoff_time)),
u as (select task_id, count(*) n, avg(stars) mean, count(*) filter (stars >= 4) hi, count(*) filter (stars <= 2) lo, max(t) last from hist group by 1)
select f.task_id, f.business_id, f.rank retrieval_rank, fusion_score, route_count, coalesce(q.score, 0) quality, coalesce(x.score, 0) category, coalesce(l.score, 0.5) location, coalesce(ts.score, 0.5) as text, coalesce(u.n, 0) history_length, round(coalesce(mean, 0), 9) average_rating,
 round(coalesce(hi / n::double, 0), 9) share_high, round(coalesce(lo / n::double, 0), 9) share_low, round((epoch_us(k.cutoff_time) - epoch_us(last)) / 86400000000.0::double, 6) days_since_last, coalesce(price_level, 0)::int price_level, coalesce(rating, 0) rating, coalesce(len(categories), 0) n_categories, coalesce(is_open, false)::int is_open, f.business_id = v.target as label
from f join v using (task_id) join tasks k on k.task_id = f.task_id left join q on q.task_id = f.task_id and q.business_id = f.business_id left join croute x on x.task_id = f.task_id and x.business_id = f.business_id left join lroute l on l.task_id = f.task_id and l.business_id = f.business_id
left join tscore ts on ts.task_id = f.task_id and ts.business_id = f.business_id left join u on u.task_id = f.task_id left join biz on biz.business_id = f.business_id""")
def ltr_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the first 100 fused candidates: routes, the user's history before the task, the business's facts, and the label."""
    k = tasks(spark, folder)
    h = R.history_of(k, interactions(spark, folder)).groupBy("task_id").agg(F.count("*").alias("n"), F.avg("stars").alias("mean"), F.count_if(c("stars") >= 4).alias("hi"), F.count_if(c("stars") <= 2).alias("lo"), F.max("t").alias("last"))
    users = _targets(spark, folder).select("task_id", "target").join(k.select("task_id", "cutoff_time"), "task_id").join(h, "task_id", "left")
    facts = businesses(spark, folder).select("business_id", "price_level", "rating", "categories", "is_open")
    f = _fused(spark, folder, 100, PER_ROUTE, _FOUR).join(users, "task_id").join(facts, "business_id", "left")
    or_zero = lambda x: F.coalesce(x, F.lit(0))
    share = lambda n: F.round(F.coalesce(c(n) / c("n"), F.lit(0.0)), 9).alias
    return f.select(
        "task_id", "business_id", c("rank").alias("retrieval_rank"), "fusion_score", c("route_count").cast("bigint").alias("route_count"), F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce(F.when(c("category") > 0, c("category")), F.lit(0.0)).alias("category"), F.coalesce("location", F.lit(0.5)).alias("location"),
        F.coalesce("text", F.lit(0.5)).alias("text"), or_zero(c("n")).alias("history_length"), F.round(F.coalesce("mean", F.lit(0.0)), 9).alias("average_rating"), share("hi")("share_high"), share("lo")("share_low"), F.round(S.age_days(c("last"), c("cutoff_time")), 6).alias("days_since_last"),
        or_zero(c("price_level").cast("int")).alias("price_level"), F.coalesce("rating", F.lit(0.0)).alias("rating"), or_zero(F.when(c("categories").isNotNull(), F.size("categories"))).cast("bigint").alias("n_categories"), F.coalesce("is_open", F.lit(False)).cast("int").alias("is_open"), (c("business_id") == c("target")).alias("label"),
    )


# evaluation


@query(f"""with {_RANKS_500}, f1 as (select task_id, max(fusion_score) filter (rank = 1) top1, max(fusion_score) filter (rank = 2) top2, max(business_id) filter (rank = 1) best, max(route_count) filter (rank = 1) top1_routes from fused group by 1)
select v.task_id, v.user_id, top1, round(top1 - coalesce(top2, 0), 9) margin, top1_routes, best = v.target top1_correct, tr.target_rank is not null target_retrieved from v join f1 using (task_id) join tr using (task_id)""")
def calibration_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """What a task's ranking shows of its confidence, and whether it was right."""
    f = _fused(spark, folder, PER_ROUTE, shown=(), wanted=_targets(spark, folder).select("task_id", c("target").alias("business_id")), head=2)  # of each list only these become rows
    at = lambda i, n: F.max(F.when(c("rank") == i, c(n)))
    shown = f.groupBy("task_id").agg(at(1, "fusion_score").alias("top1"), at(2, "fusion_score").alias("top2"), at(1, "business_id").alias("best"), at(1, "route_count").cast("bigint").alias("top1_routes"), F.collect_set("business_id").alias("all"))  # the first two and targets
    return _targets(spark, folder).join(shown, "task_id").select("task_id", "user_id", "top1", F.round(c("top1") - F.coalesce("top2", F.lit(0.0)), 9).alias("margin"), "top1_routes", (c("best") == c("target")).alias("top1_correct"), F.array_contains("all", c("target")).alias("target_retrieved"))


@query(f"""with {_RANKS_500}, q2 as (select v.task_id, q.rank qr from v left join (select * from qroute where rank <= 500) q on q.task_id = v.task_id and q.business_id = v.target)
select case when history_count < 3 then 'short' when history_count < 8 then 'middle' else 'long' end bucket, count(*) n, count(*) filter (target_rank <= 100 and qr <= 100) both_hit, count(*) filter (target_rank <= 100 and not coalesce(qr <= 100, false)) only_fused, count(*) filter (qr <= 100 and not coalesce(target_rank <= 100, false)) only_quality from tr join q2 using (task_id) group by 1""")
def paired_retrieval_comparison(spark: SparkSession, folder: str) -> DataFrame:
    both = _both_ranks(spark, folder)
    a, b = F.coalesce(c("target_rank") <= 100, F.lit(False)), F.coalesce(c("qr") <= 100, F.lit(False))
    bucket = F.when(c("history_count") < 3, "short").when(c("history_count") < 8, "middle").otherwise("long")
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both_hit"), F.count_if(a & ~b).alias("only_fused"), F.count_if(b & ~a).alias("only_quality"))


_RECALL = ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 9) recall_{k}" for k in (50, 100, 500))


@query(f"""with {_ROUTES}, {_TEXT}, {_FUSED_FOUR}, {_TARGET}, al as (select 'quality' route, task_id, business_id, rank from qroute union all select 'category', task_id, business_id, rank from croute union all select 'location', task_id, business_id, rank from lroute
 union all select 'text', task_id, business_id, rank from troute union all select 'fused', task_id, business_id, rank from fused), r as (select unnest(['quality', 'category', 'location', 'text', 'fused']) route)
select r.route, count(*) n, count(rank) n_listed, {_RECALL} from r join v on true left join (select * from al where rank <= 500) al on al.route = r.route and al.task_id = v.task_id and al.business_id = v.target group by 1""")
def route_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Which routes list a task's target, and how high."""
    targets = _targets(spark, folder).select("task_id", "target")
    # one walk ranks all routes, and of each task's lists only the target becomes a row
    listed = _fused(spark, folder, PER_ROUTE, PER_ROUTE, _FOUR, shown=(), also=dict.fromkeys(_FOUR, PER_ROUTE), wanted=targets.withColumnRenamed("target", "business_id"))
    ranks = targets.join(listed.select("task_id", c("business_id").alias("target"), *(c(f"{r}_rank").alias(r) for r in _FOUR), c("rank").alias("fused")), ["task_id", "target"], "left")
    each = ranks.select(F.explode(F.array(*(F.struct(F.lit(r).alias("route"), c(r).alias("target_rank")) for r in (*_FOUR, "fused")))).alias("x")).select("x.*")
    recall = (F.round(F.avg(F.when(c("target_rank") <= k, 1.0).otherwise(0.0)), 9).alias(f"recall_{k}") for k in (50, 100, 500))
    return each.groupBy("route").agg(F.count("*").alias("n"), F.count("target_rank").alias("n_listed"), *recall)


@query(f"""with {_QUALITY}, l as (select task_id, business_id, max_by(stars, (t, stars)) stars from hist group by 1, 2) select task_id, count(*) n_businesses, round(avg(stars), 9) mean_latest, count(*) filter (stars >= 4) n_liked from l group by 1""")
def replayed_state(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a user replayed up to each task's time: the latest rating of each business counts."""
    h = R.history_of(tasks(spark, folder), interactions(spark, folder))
    latest = h.groupBy("task_id", "business_id").agg(F.max_by("stars", F.struct("t", "stars")).alias("stars"))
    return latest.groupBy("task_id").agg(F.count("*").alias("n_businesses"), F.round(F.avg("stars"), 9).alias("mean_latest"), F.count_if(c("stars") >= 4).alias("n_liked"))


_HITS = """h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) and case_id is not null group by all),
st as (select point_id, max(stars) stars, max(coalesce(useful, 0)) useful from review_segments group by 1),
r as (select case_id, point_id, stars >= 4 rel, row_number() over (partition by case_id order by score desc, point_id) a, row_number() over (partition by case_id order by useful desc, point_id) b from h join st using (point_id))"""


@query(f"with {_HITS} select case_id, count(*) filter (rel) n_relevant, round(count(*) filter (rel and a <= 10) / nullif(count(*) filter (rel), 0)::double, 9) recall_by_score, round(count(*) filter (rel and b <= 10) / nullif(count(*) filter (rel), 0)::double, 9) recall_by_useful from r group by 1")
def evidence_recall_comparison(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score) and case_id is not null").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    st = table(spark, folder, "review_segments", "point_id", "stars", "useful").groupBy("point_id").agg(F.max("stars").alias("stars"), F.max(F.coalesce("useful", F.lit(0))).alias("useful"))
    w = Window.partitionBy("case_id")
    r = h.join(st, "point_id").withColumns({"a": F.row_number().over(w.orderBy(c("score").desc(), "point_id")), "b": F.row_number().over(w.orderBy(c("useful").desc(), "point_id")), "rel": c("stars") >= 4})
    recall = lambda n: F.round(F.count_if(c("rel") & (c(n) <= 10)) / F.nullif(F.count_if("rel").cast("double"), F.lit(0.0)), 9)
    return r.groupBy("case_id").agg(F.count_if("rel").alias("n_relevant"), recall("a").alias("recall_by_score"), recall("b").alias("recall_by_useful"))


_KEYWORDS = {"parking": "parking|停", "pet_friendly": "dog|pet|狗", "family_friendly": "kids|family|小孩", "queue_time": "wait|line|排队", "service": "waiter|server|service|服务"}
_PARSED = " union all ".join(f"select distinct case_id, '{field}' field from q where regexp_matches(t, '{pattern}')" for field, pattern in _KEYWORDS.items())


@query(f"""with {_ASKED}, {_CONDITIONS}, said as ({_PARSED}), k as (select unnest({list(_KEYWORDS)}) field), e as (select distinct case_id, field from cond),
j as (select coalesce(said.field, e.field) field, said.case_id is not null s, e.case_id is not null e from said full join e on said.case_id = e.case_id and said.field = e.field)
select field, count(*) filter (s) said, count(*) filter (e) expected, count(*) filter (s and e) hit, round(count(*) filter (s and e) / nullif(count(*) filter (s), 0)::double, 9) as precision, round(count(*) filter (s and e) / nullif(count(*) filter (e), 0)::double, 9) recall from j where field in (select field from k) group by 1""")
def parser_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """A keyword reader's fields against the expected ones."""
    asked = table(spark, folder, "seed_queries", "case_id", "query_text").where("query_text is not null").select("case_id", F.lower("query_text").alias("t")).distinct()
    found = F.array_compact(F.array(*(F.when(c("t").rlike(pattern), F.lit(field)) for field, pattern in _KEYWORDS.items())))
    said = asked.select("case_id", F.explode(found).alias("field")).distinct().withColumn("s", F.lit(True))
    expected = _conditions(spark, folder).select("case_id", "field").distinct().withColumn("e", F.lit(True))
    j = said.join(expected, ["case_id", "field"], "full").where(c("field").isin(*_KEYWORDS)).fillna(False, ["s", "e"])
    ratio = lambda d: F.round(F.count_if(c("s") & c("e")) / F.nullif(F.count_if(d).cast("double"), F.lit(0.0)), 9)
    return j.groupBy("field").agg(F.count_if("s").alias("said"), F.count_if("e").alias("expected"), F.count_if(c("s") & c("e")).alias("hit"), ratio("s").alias("precision"), ratio("e").alias("recall"))


@query("""select event_type step, count(*) n, round(avg(value), 6) mean_ms, round(quantile_cont(value, 0.5), 9) p50_ms, round(quantile_cont(value, 0.95), 9) p95_ms, max(value) max_ms, count(distinct user_id) n_sessions, count(*) filter (value > 90) n_slow from events where value is not null group by 1""")
def trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_type", "value", "user_id").where("value is not null")
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 9)
    return e.groupBy(c("event_type").alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), q(0.5).alias("p50_ms"), q(0.95).alias("p95_ms"), F.max("value").alias("max_ms"), F.countDistinct("user_id").alias("n_sessions"), F.count_if(c("value") > 90).alias("n_slow"))


@query(f"""with {INTER}, x as (select least(19, floor(((epoch_us(t) // 1000000) % 1000) / 50.0::double))::int bin, (stars >= 4)::int o from inter), b as (select bin, count(*) n, sum(o) s from x group by 1),
m as (select i.bin, j.bin lo, k.bin hi, (select sum(s) / sum(n)::double from b where bin between j.bin and k.bin) mean from b i, b j, b k where j.bin <= i.bin and k.bin >= i.bin),
l as (select bin, lo, min(mean) mn from m group by 1, 2) select bin, round(max(mn), 9) fitted from l group by 1""")
def isotonic_calibration(spark: SparkSession, folder: str) -> DataFrame:
    second = F.pmod(F.floor(S.micros(c("t")) / 1_000_000), F.lit(1000)) / 50.0
    x = interactions(spark, folder).select(F.least(F.lit(19), F.floor(second)).cast("int").alias("bin"), (c("stars") >= 4).cast("int").alias("o"))
    return M.isotonic(x, "bin", "o").select("bin", F.round("fitted", 9).alias("fitted"))


@query(f"""with {_ASKED}, t as (select case_id, regexp_extract_all(t, '[a-z0-9]+') w from q) select case_id, len(w) n_terms, len(list_distinct(w)) n_different, round(len(list_distinct(w)) / nullif(len(w), 0)::double, 9) share from t""")
def request_statistics(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "seed_queries", "case_id", "query_text").where("query_text is not null").select("case_id", "query_text").distinct()
    w = T.latin_words(c("query_text"))
    return asked.select("case_id", F.size(w).cast("bigint").alias("n_terms"), F.size(F.array_distinct(w)).cast("bigint").alias("n_different"), F.round(F.size(F.array_distinct(w)) / F.nullif(F.size(w).cast("double"), F.lit(0.0)), 9).alias("share"))
