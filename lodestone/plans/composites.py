"""Composite queries: candidate sets, feature tables, readers of requests and pages, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import retrieval as R
from lodestone.plans.base import BIZ, INTER, TASKS, businesses, interactions, tasks
from lodestone.plans.knowledge import _TARGET, _targets
from lodestone.plans.recommend import _CATEGORY, _FUSED, _FUSED_500, _LOCATION, _QUALITY, _QUALITY_ROUTE, _ROUTES, PER_ROUTE, _category_route, _fused, _location_route, _quality_route, _ranked
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


_REQUESTS = "req as (select distinct case_id, query_text from seed_queries union select distinct case_id, query_text from long_tail_02)"


@query(rf"""with {_REQUESTS} select case_id, regexp_extract(lower(query_text), 'under \$([0-9]+[.]?[0-9]*)', 1) max_price, regexp_extract(lower(query_text), 'for ([0-9]+) people', 1) party,
 regexp_extract(lower(query_text), 'open past ([0-9]+:[0-9]+)', 1) open_past, contains(lower(query_text), 'parking') wants_parking, regexp_extract(lower(query_text), 'with ([a-z]+) but no ([a-z]+)', 2) excluded,
 case when contains(lower(query_text), 'under $') then 'hard' else 'soft' end enforcement from req where query_text is not null""")
def request_conditions(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, n, "case_id", "query_text") for n in ("seed_queries", "long_tail_02")]
    low = F.lower("query_text")
    return parts[0].union(parts[1]).distinct().where("query_text is not null").select(
        "case_id", F.regexp_extract(low, r"under \$([0-9]+[.]?[0-9]*)", 1).alias("max_price"), F.regexp_extract(low, "for ([0-9]+) people", 1).alias("party"), F.regexp_extract(low, "open past ([0-9]+:[0-9]+)", 1).alias("open_past"),
        F.contains(low, F.lit("parking")).alias("wants_parking"), F.regexp_extract(low, "with ([a-z]+) but no ([a-z]+)", 2).alias("excluded"), F.when(F.contains(low, F.lit("under $")), "hard").otherwise("soft").alias("enforcement"),
    )


@query(rf"""with {_REQUESTS}, x as (select case_id, lower(query_text) q from req where query_text is not null), d as (select 'price' slot, '40' default_value union all select 'party', '2')
select case_id, slot, coalesce(nullif(case slot when 'price' then regexp_extract(q, 'under \$([0-9]+[.]?[0-9]*)', 1) else regexp_extract(q, 'for ([0-9]+) people', 1) end, ''), default_value) v,
 (case slot when 'price' then regexp_extract(q, 'under \$([0-9]+[.]?[0-9]*)', 1) else regexp_extract(q, 'for ([0-9]+) people', 1) end) <> '' explicit from x, d""")
def default_override(spark: SparkSession, folder: str) -> DataFrame:
    explicit = request_conditions(spark, folder).select("case_id", F.explode(F.array(F.struct(F.lit("price").alias("slot"), c("max_price").alias("said"), F.lit("40").alias("d")), F.struct(F.lit("party").alias("slot"), c("party").alias("said"), F.lit("2").alias("d")))).alias("x")).select("case_id", "x.*")
    return explicit.select("case_id", "slot", F.when(c("said") != "", c("said")).otherwise(c("d")).alias("v"), (c("said") != "").alias("explicit"))


@query(r"""with p as (select doc_id, business_id, regexp_extract(text, 'Business: ([^\n]*)', 1) name, regexp_extract(text, 'Wed ([0-9]+:[0-9]+)-([0-9]+:[0-9]+)', 1) a, regexp_extract(text, 'Wed ([0-9]+:[0-9]+)-([0-9]+:[0-9]+)', 2) b from documents where starts_with(text, 'Business: ')),
m as (select doc_id, name, try_cast(split_part(a, ':', 1) as int) * 60 + try_cast(split_part(a, ':', 2) as int) s, try_cast(split_part(b, ':', 1) as int) * 60 + try_cast(split_part(b, ':', 2) as int) e from p)
select doc_id, name, s, e, case when s = e then false when s < e then 600 >= s and 600 < e when s > e then 600 >= s or 600 < e end open_wed_10 from m""")
def open_at_from_profiles(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").where(F.startswith("text", F.lit("Business: ")))
    span = r"Wed ([0-9]+:[0-9]+)-([0-9]+:[0-9]+)"
    minute = lambda i: F.expr(f"try_cast(split_part(regexp_extract(text, r'{span}', {i}), ':', 1) as int) * 60 + try_cast(nullif(split_part(regexp_extract(text, r'{span}', {i}), ':', 2), '') as int)")
    m = d.select("doc_id", F.regexp_extract("text", r"Business: ([^\n]*)", 1).alias("name"), minute(1).alias("s"), minute(2).alias("e"))
    return m.select("doc_id", "name", "s", "e", S.open_at(c("s"), c("e"), F.lit(600)).alias("open_wed_10"))


@query(f"""with {BIZ} select business_id, concat_ws('. ', coalesce(trim(name), ''), 'Categories: ' || coalesce(array_to_string(list_sort([x for x in categories if x is not null]), ', '), 'unknown'),
 'Price: ' || coalesce(price_level::varchar, 'unknown'), 'Outdoor seating: ' || case when outdoor_seating then 'yes' when outdoor_seating is false then 'no' else 'unknown' end) doc, sha256(concat_ws(chr(0), business_id, coalesce(city, ''))) h from biz""")
def static_documents(spark: SparkSession, folder: str) -> DataFrame:
    cats = F.coalesce(F.array_join(F.array_sort(F.array_compact("categories")), ", "), F.lit("unknown"))
    seats = F.when(c("outdoor_seating"), "yes").when(~c("outdoor_seating"), "no").otherwise("unknown")
    doc = F.concat_ws(". ", F.coalesce(F.trim("name"), F.lit("")), F.concat(F.lit("Categories: "), cats), F.concat(F.lit("Price: "), F.coalesce(c("price_level").cast("string"), F.lit("unknown"))), F.concat(F.lit("Outdoor seating: "), seats))
    return businesses(spark, folder).select("business_id", doc.alias("doc"), F.sha2(F.concat_ws("\0", "business_id", F.coalesce("city", F.lit(""))), 256).alias("h"))


@query(f"""with {BIZ}, u as (select distinct business_id, unnest(categories) category from biz), inv as (select category, count(*) n from u where category is not null group by 1),
p as (select category, n, case when category ilike '%bar%' then 'Bars' when category in ('Bakeries', 'Desserts', 'Coffee & Tea') then 'Sweet' else category end parent from inv)
select category, n, n >= 20 selectable, parent, parent = category parent_is_category from p""")
def category_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    inv = businesses(spark, folder).select("business_id", F.explode("categories").alias("category")).where("category is not null").distinct().groupBy("category").agg(F.count("*").alias("n"))
    parent = F.when(F.contains(F.lower("category"), F.lit("bar")), "Bars").when(c("category").isin("Bakeries", "Desserts", "Coffee & Tea"), "Sweet").otherwise(c("category"))
    return inv.select("category", "n", (c("n") >= 20).alias("selectable"), parent.alias("parent"), (parent == c("category")).alias("parent_is_category"))


@query("""with h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all), s as (select point_id, min(review_id) review_id, max(contains(lower(segment_text), 'parking')::int) kw from review_segments group by 1),
k as (select distinct h.case_id, s.review_id from h join s using (point_id) where kw = 1), d as (select case_id, review_id, max(score) best from h join s using (point_id) where score >= 0.5 group by 1, 2)
select coalesce(d.case_id, k.case_id) case_id, coalesce(d.review_id, k.review_id) review_id, best, d.case_id is not null semantic_hit, k.case_id is not null keyword_hit from d full join k on d.case_id = k.case_id and d.review_id = k.review_id""")
def dense_keyword_rollup(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    s = table(spark, folder, "review_segments", "point_id", "review_id", "segment_text").groupBy("point_id").agg(F.min("review_id").alias("review_id"), F.max(F.contains(F.lower("segment_text"), F.lit("parking"))).alias("kw"))
    # both routes come from one pass over the hits, which equals the full outer join of the two lists
    both = h.join(s, "point_id").where(c("review_id").isNotNull()).groupBy("case_id", "review_id").agg(F.max(F.when(c("score") >= 0.5, c("score"))).alias("best"), F.max(F.coalesce("kw", F.lit(False))).alias("keyword_hit"))
    return both.where("best is not null or keyword_hit").select("case_id", "review_id", "best", c("best").isNotNull().alias("semantic_hit"), "keyword_hit")


@query("""with h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all), s as (select point_id, min(business_id) business_id, max(stars) stars, max(coalesce(useful, 0)) useful, max(review_time) rt from review_segments where business_id is not null group by 1),
w as (select case_id, business_id, stars, score * pow(0.5, (epoch_us(timestamp '2025-01-01') - epoch_us(rt)) / 86400000000.0::double / 730) * (1 + least(useful, 10) / 10.0::double) w from h join s using (point_id) where rt is not null)
select case_id, business_id, count(*) n, round(sum(w * (stars - 1) / 4) / nullif(sum(w), 0), 7) degree from w group by 1, 2""")
def evidence_degree(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    s = table(spark, folder, "review_segments", "point_id", "business_id", "stars", "useful", "review_time").where("business_id is not null").groupBy("point_id").agg(F.min("business_id").alias("business_id"), F.max("stars").alias("stars"), F.max(F.coalesce("useful", F.lit(0))).alias("useful"), F.max("review_time").alias("rt")).where("rt is not null")
    w = c("score") * S.half_life_weight(S.age_days(c("rt"), F.lit("2025-01-01").cast("timestamp_ntz")), 730.0) * (1 + F.least("useful", F.lit(10)) / 10.0)
    return h.join(s, "point_id").withColumn("w", w).groupBy("case_id", "business_id").agg(F.count("*").alias("n"), F.round(F.sum(c("w") * (c("stars") - 1) / 4) / F.nullif(F.sum("w"), F.lit(0.0)), 7).alias("degree"))


@query(f"""with {_ROUTES}, u as (select task_id, business_id, rank, 1 r from qroute where rank <= 20 union all select task_id, business_id, rank, 2 from croute where rank <= 20 union all select task_id, business_id, rank, 3 from lroute where rank <= 20),
f as (select task_id, business_id, min((rank, r)) o from u group by 1, 2) select task_id, business_id, row_number() over (partition by task_id order by o) position from f qualify position <= 25""")
def round_robin_union(spark: SparkSession, folder: str) -> DataFrame:
    routes = [_quality_route(spark, folder, 20), _category_route(spark, folder, 20), _location_route(spark, folder, 20)]
    union = None
    for i, r in enumerate(routes, 1):
        part = r.select("task_id", "business_id", c("rank").alias("k"), F.lit(i).alias("r"))
        union = part if union is None else union.union(part)
    first = union.groupBy("task_id", "business_id").agg(F.min(F.struct("k", "r")).alias("o"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("task_id").orderBy("o"))).where("position <= 25").select("task_id", "business_id", "position")


@query(f"""with {TASKS}, o as (select *, row_number() over (partition by user_id order by sha256('unique:' || task_id)) k from tasks), p as (select task_id, user_id, sha256('split:' || user_id) h, row_number() over (order by sha256('split:' || user_id)) r, count(*) over () n from o where k = 1)
select task_id, user_id, case when r <= n * 0.5::double then 'development' else 'test' end part from p""")
def unique_user_selection(spark: SparkSession, folder: str) -> DataFrame:
    one = tasks(spark, folder).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(S.hash_order("unique", c("task_id"))))).where("k = 1").withColumn("h", S.hash_order("split", c("user_id")))
    # the half of the users with the lower hash: ranked inside 256 hash ranges after the ranges are counted, not in one sort
    ranged = one.withColumn("p", F.substring("h", 1, 2))
    sizes = ranged.groupBy("p").count()
    upto = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows
    before = sizes.select("p", (F.sum("count").over(upto) - c("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    r = c("before") + F.row_number().over(Window.partitionBy("p").orderBy("h"))
    return ranged.join(F.broadcast(before), "p").select("task_id", "user_id", F.when(r <= c("n") * 0.5, "development").otherwise("test").alias("part"))


@query(f"""with {_ROUTES}, {_FUSED}, {_TARGET}, f as (select * from fused where rank <= 20)
select f.task_id, f.business_id, f.rank retrieval_rank, coalesce(q.score, 0) quality, coalesce(x.score, 0) category, coalesce(l.score, 0.5) location, l.km is null location_missing, round(ln(1 + n), 9) log_reviews, v.history_count, f.business_id = v.target as label
from f join v using (task_id) left join (select * from qroute where rank <= 50) q using (task_id, business_id) left join (select * from croute where rank <= 50) x using (task_id, business_id) left join (select * from lroute where rank <= 50) l using (task_id, business_id)
left join (select business_id, count(*) n from inter group by 1) using (business_id)""")
def ranking_features(spark: SparkSession, folder: str) -> DataFrame:
    key = ["task_id", "business_id"]
    score = lambda df, n: df.select(*key, c("score").alias(n))
    n = interactions(spark, folder).groupBy("business_id").agg(F.count("*").alias("n"))
    f = _fused(spark, folder, 20, 50).select(*key, c("rank").alias("retrieval_rank")).join(_targets(spark, folder).select("task_id", "history_count", "target"), "task_id")
    f = f.join(score(_quality_route(spark, folder, 50), "q"), key, "left").join(score(_category_route(spark, folder, 50), "x"), key, "left").join(score(_location_route(spark, folder, 50), "l"), key, "left").join(n, "business_id", "left")
    return _feature_row(f)


def _feature_row(f: DataFrame) -> DataFrame:
    key, zero = ["task_id", "business_id"], F.lit(0.0)
    return f.select(*key, "retrieval_rank", F.coalesce("q", zero).alias("quality"), F.coalesce("x", zero).alias("category"), F.coalesce("l", F.lit(0.5)).alias("location"), c("l").isNull().alias("location_missing"), F.round(F.log1p("n"), 9).alias("log_reviews"), "history_count", (c("business_id") == c("target")).alias("label"))


@query(f"""with {_ROUTES}, {_FUSED_500}, {_TARGET}, f as (select * from fused where rank <= {PER_ROUTE}), q as (select k.task_id, quality.business_id, quality score from tasks k join quality using (cutoff_time))
select f.task_id, f.business_id, f.rank retrieval_rank, coalesce(q.score, 0) quality, coalesce(x.score, 0) category, coalesce(l.score, 0.5) location, l.km is null location_missing, round(ln(1 + n), 9) log_reviews, v.history_count, f.business_id = v.target as label
from f join v using (task_id) left join q using (task_id, business_id) left join croute x using (task_id, business_id) left join lroute l using (task_id, business_id)
left join (select business_id, count(*) n from inter group by 1) using (business_id)""")
def ranking_features_500(spark: SparkSession, folder: str) -> DataFrame:
    """Features of every fused candidate from the uncut scores; a default stands only where the score is unknown."""
    key = ["task_id", "business_id"]
    n = interactions(spark, folder).groupBy("business_id").agg(F.count("*").alias("n"))
    f = _fused(spark, folder, PER_ROUTE).select(*key, c("rank").alias("retrieval_rank"), c("quality").alias("q"), c("category").alias("x"), c("location").alias("l"))
    return _feature_row(f.join(_targets(spark, folder).select("task_id", "history_count", "target"), "task_id").join(n, "business_id", "left"))


@query(f"""with {_QUALITY}, {_QUALITY_ROUTE}, {_CATEGORY}, {_LOCATION}, b as (select q.task_id, q.business_id, q.score q, coalesce(x.score, 0) x, coalesce(l.score, 0.5) l from (select * from qroute where rank <= 100) q left join croute x using (task_id, business_id) left join lroute l using (task_id, business_id)),
s as (select task_id, business_id, round(0.4::double * x / 0.7::double + 0.2::double * q / 0.7::double + 0.1::double * l / 0.7::double, 9) score from b) select task_id, business_id, score, row_number() over (partition by task_id order by score desc, business_id) rank from s qualify rank <= 10""")
def weighted_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    key = ["task_id", "business_id"]
    b = _ranked(spark, folder, "quality", 100).select(*key, c("score").alias("q"), c("category").alias("x"), c("location").alias("l"))
    score = 0.4 * F.coalesce("x", F.lit(0.0)) / 0.7 + 0.2 * c("q") / 0.7 + 0.1 * F.coalesce("l", F.lit(0.5)) / 0.7
    return R.route_top(b.select(*key, score.alias("score")), "task_id", "business_id", "score", 10)


@query(f"""with {_ROUTES}, {_FUSED}, f as (select * from fused where rank <= 30), n as (select business_id, count(*) k from f group by 1)
select count(*) n_rows, count(distinct business_id) n_businesses, (select count(*) from biz) n_catalogue, (select max(k) from n) most_seen, round((select quantile_cont(k::double, 0.95) from n), 9) p95_seen, count(distinct task_id) n_tasks from f""")
def candidate_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, _fused(spark, folder, 30, 50, shown=()))


@query(SQL["candidate_audit"].replace(_FUSED, _FUSED_500).replace("from fused where rank <= 30", f"from fused where rank <= {PER_ROUTE}"))
def candidate_audit_500(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder, _fused(spark, folder, PER_ROUTE, shown=()))


def _audit(spark: SparkSession, folder: str, f: DataFrame) -> DataFrame:
    # one walk: a row counts for its business, and the first of a list for its task as well
    marks = F.array(F.struct(F.lit(True).alias("item"), c("business_id").alias("id")))
    both = F.when(c("rank") == 1, F.concat(marks, F.array(F.struct(F.lit(False).alias("item"), c("task_id").alias("id"))))).otherwise(marks)
    per = f.select(F.explode(both).alias("x")).groupBy("x.item", "x.id").agg(F.count("*").alias("k"))
    k = F.when(c("item"), c("k"))
    seen = per.agg(F.coalesce(F.sum(k), F.lit(0)).alias("n_rows"), F.count(k).alias("n_businesses"), F.max(k).alias("most_seen"), F.round(F.percentile(k.cast("double"), F.lit(0.95)), 9).alias("p95_seen"), F.count_if(~c("item")).alias("n_tasks"))
    return seen.crossJoin(businesses(spark, folder).agg(F.count("*").alias("n_catalogue")))


@query("""select count(*) n, count(*) filter (char_start < 0 or char_end <= char_start) bad_offsets, count(*) filter (sha256(segment_text) <> text_sha256) bad_hash, count(*) filter (char_end - char_start <> length(segment_text)) bad_length, count(distinct review_id) n_reviews, count(*) - count(distinct segment_id) n_repeats from review_segments""")
def passage_audit(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "review_segments", "char_start", "char_end", "segment_text", "text_sha256", "review_id", "segment_id")
    return s.agg(
        F.count("*").alias("n"), F.count_if((c("char_start") < 0) | (c("char_end") <= c("char_start"))).alias("bad_offsets"), F.count_if(F.sha2("segment_text", 256) != c("text_sha256")).alias("bad_hash"),
        F.count_if(c("char_end") - c("char_start") != F.length("segment_text")).alias("bad_length"), F.countDistinct("review_id").alias("n_reviews"), (F.count("*") - F.countDistinct("segment_id")).alias("n_repeats"),
    )


@query("""with h as (select case_id, max(score) filter (k = 1) s1, coalesce(max(score) filter (k = 2), 0) s2 from (select case_id, score, row_number() over (partition by case_id order by score desc, point_id) k from (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all)) group by 1),
q as (select quantile_cont(s1, 0.25) a, quantile_cont(s1 - s2, 0.25) b from h)
select case_id, concat_ws(',', case when s1 < a then 'low_top' end, case when s1 - s2 < b then 'small_margin' end) reasons from h, q""")
def readiness_reasons(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    top = h.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy(c("score").desc(), "point_id"))).where("k <= 2")
    s = top.groupBy("case_id").agg(F.max(F.when(c("k") == 1, c("score"))).alias("s1"), F.coalesce(F.max(F.when(c("k") == 2, c("score"))), F.lit(0.0)).alias("s2"))
    q = s.agg(F.percentile("s1", F.lit(0.25)).alias("a"), F.percentile(c("s1") - c("s2"), F.lit(0.25)).alias("b"))  # one row
    return s.crossJoin(F.broadcast(q)).select("case_id", F.concat_ws(",", F.when(c("s1") < c("a"), "low_top"), F.when(c("s1") - c("s2") < c("b"), "small_margin")).alias("reasons"))


@query(f"""with {INTER}, {BIZ}, {TASKS}, {_TARGET}, t as (select v.task_id, v.target, b.city, b.categories[1] fine from v join biz b on b.business_id = v.target),
c1 as (select t.task_id, b.business_id, case when b.categories[1] = t.fine then 1 when list_has_any(b.categories, x.categories) then 2 when b.price_level = x.price_level then 3 else 4 end bucket from t join biz x on x.business_id = t.target join biz b on b.business_id <> t.target and b.city = t.city),
r as (select *, row_number() over (partition by task_id, bucket order by sha256('pick:' || task_id || ':' || business_id)) k from c1 where bucket is not null),
s as (select *, case when k <= case bucket when 1 then 8 when 2 then 5 else 3 end then 0 else 1 end refill from r),
f as (select *, row_number() over (partition by task_id order by refill, bucket, k) p from s)
select task_id, business_id, bucket, refill = 1 refilled, p position from f where p <= 19""")
def bucketed_candidates(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder).select("business_id", "city", "categories", "price_level")
    x = b.select(c("business_id").alias("target"), "city", c("categories").alias("xc"), c("price_level").alias("xp"))
    pairs = _targets(spark, folder).select("task_id", "target").join(x, "target").join(b, "city").where("business_id <> target")
    fine = lambda n: F.get(n, F.lit(0))
    bucket = F.when(fine("categories") == fine("xc"), 1).when(F.arrays_overlap("categories", "xc"), 2).when(c("price_level") == c("xp"), 3).otherwise(4)
    ranked = pairs.withColumn("bucket", bucket).withColumn("k", F.row_number().over(Window.partitionBy("task_id", "bucket").orderBy(S.hash_order("pick", c("task_id"), c("business_id")))))
    room = F.when(c("bucket") == 1, 8).when(c("bucket") == 2, 5).otherwise(3)
    placed = ranked.withColumn("refilled", c("k") > room).withColumn("position", F.row_number().over(Window.partitionBy("task_id").orderBy("refilled", "bucket", "k"))).where("position <= 19")
    return placed.select("task_id", "business_id", "bucket", "refilled", "position")


@query("""with s as (select distinct segment_id, review_id, segment_index, char_start, char_end from review_segments), m as (select review_id, min(char_start) + 40 a, min(char_start) + 60 b from s group by 1),
o as (select s.review_id, s.segment_id, row_number() over (partition by s.review_id order by not (s.char_start < m.b and s.char_end > m.a), s.segment_index, s.segment_id) r from s join m using (review_id)) select review_id, segment_id from o where r = 1""")
def span_to_segment(spark: SparkSession, folder: str) -> DataFrame:
    """The first passage that overlaps a span of the review, else its first passage; spans here are characters 40 to 60."""
    s = table(spark, folder, "review_segments", "segment_id", "review_id", "segment_index", "char_start", "char_end").distinct()
    start = F.min("char_start").over(Window.partitionBy("review_id"))
    miss = ~((c("char_start") < start + 60) & (c("char_end") > start + 40))
    w = Window.partitionBy("review_id").orderBy("miss", "segment_index", "segment_id")
    return s.where("review_id is not null").withColumn("miss", miss).withColumn("r", F.row_number().over(w)).where("r = 1").select("review_id", "segment_id")


@query("""with h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all), s as (select point_id, max(stars) stars from review_segments group by 1)
select case_id, point_id, case when score < 0.3 then 'ambiguous' when stars >= 4 then 'positive' when stars <= 2 then 'negative' else 'ambiguous' end direction from h join s using (point_id)""")
def evidence_direction(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    s = table(spark, folder, "review_segments", "point_id", "stars").groupBy("point_id").agg(F.max("stars").alias("stars"))
    direction = F.when(c("score") < 0.3, "ambiguous").when(c("stars") >= 4, "positive").when(c("stars") <= 2, "negative").otherwise("ambiguous")
    return h.join(s, "point_id").select("case_id", "point_id", direction.alias("direction"))
