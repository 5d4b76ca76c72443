"""Sources and sinks in a round trip, readers of conditions, plug-ins, audits and sampling on the tables of one folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import metrics as M
from lodestone.operators import text as T
from lodestone.operators.learning import batch_score, linear, score_pairs
from lodestone.operators.splits import grouped_split
from lodestone.plans.base import BIZ, INTER, TASKS, businesses, interactions, tasks
from lodestone.plans.recommend import _QUALITY, _QUALITY_ROUTE, _TEXT, _fused, _ranked
from lodestone.sources import files as X
from lodestone.sources.tables import table
from lodestone.sources.workspace import scratch_path

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


def _lines(df: DataFrame, label: str) -> str:
    """``df`` as JSON lines in the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


# sources and sinks


@query(f"""with {BIZ}, town as (select min(lower(trim(city))) t from biz), x as (select business_id, name, city, [trim(y) for y in categories if y is not null and trim(y) <> ''] cats, is_open, review_count from biz)
select business_id, name, city, len(cats) n_categories from x, town where trim(business_id) <> '' and lower(trim(city)) = t and is_open and review_count >= 1 and list_contains(cats, 'Restaurants')""")
def jsonl_businesses(spark: SparkSession, folder: str) -> DataFrame:
    b = businesses(spark, folder)
    attributes = F.to_json(F.struct("outdoor_seating", "noise_level"))
    raw = b.select("business_id", "name", "address", "city", "state", "postal_code", "latitude", "longitude", c("rating").alias("stars"), "review_count", c("is_open").cast("int").alias("is_open"), attributes.alias("attributes"), F.array_join(F.array_compact("categories"), ", ").alias("categories"))
    good, _ = X.json_lines(spark, _lines(raw, "businesses"), X.BUSINESS)
    town = b.agg(F.min(F.lower(F.trim("city")))).first()[0] or ""
    kept, _ = X.curated_businesses(good, town, ["Restaurants"])
    return kept.select("business_id", "name", "city", F.size("categories").cast("bigint").alias("n_categories"))


@query(f"""with {BIZ} select review_id, user_id, business_id, stars, useful, date_trunc('second', review_time)::timestamp t from reviews
where business_id in (select business_id from biz) and trim(review_id) <> '' and trim(user_id) <> '' and stars between 1 and 5 and text is not null and review_time is not null""")
def jsonl_reviews(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "reviews", "review_id", "user_id", "business_id", "stars", "useful", "funny", "cool", "text", "review_time")
    lines = _lines(raw.withColumn("date", F.date_format("review_time", "yyyy-MM-dd HH:mm:ss")).drop("review_time"), "reviews")
    good, _ = X.json_lines(spark, lines, X.REVIEW)
    kept, _ = X.curated_reviews(good, businesses(spark, folder))
    return kept.select("review_id", "user_id", "business_id", "stars", "useful", c("date").alias("t"))


@query(f"""with {INTER}, u as (select user_id, date_trunc('second', min(cutoff_time))::timestamp since from profile_snapshots where user_id is not null group by 1)
select user_id, 'user ' || user_id as name, since from u where user_id in (select user_id from inter)""")
def jsonl_users(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "profile_snapshots", "user_id", "cutoff_time").where("user_id is not null").groupBy("user_id").agg(F.date_format(F.min("cutoff_time"), "yyyy-MM-dd HH:mm:ss").alias("joined"))
    good, _ = X.json_lines(spark, _lines(u.withColumn("name", F.concat(F.lit("user "), "user_id")), "users"), "user_id string, name string, joined string")
    return X.curated_users(good, interactions(spark, folder), "joined")


@query("select distinct task_id, split, user_id, cutoff_time, history_count::int history_count from temporal_contexts where task_id is not null and user_id is not null and cutoff_time is not null")
def parquet_sink_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sink")
    X.write_parquet(tasks(spark, folder).dropna(subset=["task_id", "user_id", "cutoff_time"]), path, "task_id string not null, split string, user_id string not null, cutoff_time timestamp_ntz not null, history_count int")
    return spark.read.parquet(path)


@query("""with s as (select user_id, history_length, average_rating, profile_id, row_number() over (partition by user_id order by cutoff_time desc, recorded_time desc nulls last, profile_id desc) r from (select distinct * from profile_snapshots) where user_id is not null and cutoff_time is not null)
select user_id, profile_id, history_length, average_rating from s where r = 1""")
def profile_store_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles put into a store in two batches, and the latest of each user read from it."""
    store = X.VersionedStore(spark, scratch_path(spark, "profiles"), ["user_id"], ["cutoff_time", "recorded_time", "profile_id"])
    rows = table(spark, folder, "profile_snapshots", "user_id", "profile_id", "cutoff_time", "recorded_time", "history_length", "average_rating").where("user_id is not null and cutoff_time is not null")
    late = F.pmod(F.xxhash64("profile_id"), F.lit(2)) == 1
    store.put(rows.where(late))
    store.put(rows.where(~late))
    return store.latest().select("user_id", "profile_id", "history_length", "average_rating")


@query(f"with {BIZ} select city, count(*) n, max(rating) best from biz group by 1")
def reused_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table that is built at the first call and only read at the second."""
    out = scratch_path(spark, "reused") + "/table"
    built: list[int] = []

    def build() -> DataFrame:
        built.append(1)
        return businesses(spark, folder).groupBy("city").agg(F.count("*").alias("n"), F.max("rating").alias("best"))

    for _ in range(2):
        found = X.built_once(spark, out, [f"{folder}/business_fact_versions.parquet"], {"by": "city"}, build)
    if len(built) != 1:
        raise RuntimeError("the table was built again")
    return found


# scalars and texts


@query(f"""with {BIZ} select business_id, 'outdoor seating' attribute, outdoor_seating::varchar v from biz where outdoor_seating is not null union all select business_id, 'noise level', noise_level from biz where noise_level is not null
union all select business_id, 'details price range 2', price_level::varchar from biz where price_level is not null union all select business_id, 'details rated', case when rating >= 4 then 'true' else 'false' end from biz where rating is not null""")
def flattened_attributes(spark: SparkSession, folder: str) -> DataFrame:
    nested = F.struct(c("price_level").alias("PriceRange_2"), (c("rating") >= 4).alias("Rated"))
    rows = businesses(spark, folder).select("business_id", F.to_json(F.struct(c("outdoor_seating").alias("OutdoorSeating"), c("noise_level").alias("NoiseLevel"), nested.alias("Details"))).alias("attributes"))
    return T.flatten_json(rows, "business_id", "attributes").select("business_id", S.humanize(F.array_join("path", " ")).alias("attribute"), c("value").alias("v"))


@query(f"""with {BIZ} select business_id, outdoor_seating outdoor, case when price_level between 1 and 4 then price_level end::int price, noise_level is not null and noise_level in ('quiet', 'average') calm from biz""")
def normalized_attributes(spark: SparkSession, folder: str) -> DataFrame:
    dumped = F.concat(F.lit("u'"), F.initcap(c("outdoor_seating").cast("string")), F.lit("'"))
    price = F.regexp_extract(F.concat(F.lit("'"), c("price_level").cast("string"), F.lit("'")), r"^u?'?([1-4])'?$", 1)
    noise = F.lower(F.regexp_replace(F.concat(F.lit("u'"), "noise_level", F.lit("'")), r"^u?'|'$", ""))
    return businesses(spark, folder).select("business_id", S.tri_state(dumped).alias("outdoor"), F.nullif(price, F.lit("")).cast("int").alias("price"), F.coalesce(noise.isin("quiet", "average"), F.lit(False)).alias("calm"))


_DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
_PROBES = ((0, 90), (2, 600), (5, 1410), (6, 15))
_SPANS = ", ".join(f"regexp_extract(text, '{d} ([0-9]+):([0-9]+)-([0-9]+):([0-9]+)', ['a', 'b', 'c', 'd']) {d}" for d in _DAYS)
_MINUTES = ", ".join(f"try_cast({d}.a as int) * 60 + try_cast({d}.b as int) {d}_s, try_cast({d}.c as int) * 60 + try_cast({d}.d as int) {d}_e" for d in _DAYS)
_OPEN = ", ".join(
    f"case when {d}_s < {d}_e and {m} >= {d}_s and {m} < {d}_e or {d}_s > {d}_e and {m} >= {d}_s or {p}_s > {p}_e and {m} < {p}_e then true when {d}_s is null and {p}_s is null then null when {d}_s is null then null else false end open_{d.lower()}_{m}"
    for d, p, m in ((_DAYS[i], _DAYS[i - 1], m) for i, m in _PROBES)
)


@query(f"with x as (select doc_id, {_SPANS} from documents where starts_with(text, 'Business: ')), t as (select doc_id, {_MINUTES} from x) select doc_id, {_OPEN} from t")
def weekly_open_at(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a business is open at some times of the week, the overnight span of the day before included."""
    d = table(spark, folder, "documents", "doc_id", "text").where(F.startswith("text", F.lit("Business: ")))

    def minute(day: str, first: int):  # noqa: ANN202
        part = lambda i: F.nullif(F.regexp_extract("text", f"{day} ([0-9]+):([0-9]+)-([0-9]+):([0-9]+)", i), F.lit("")).try_cast("int").cast("bigint")  # noqa: E731  # digits beyond an int are unknown, as in the SQL
        return part(first) * 60 + part(first + 1)

    span = {day: (minute(day, 1), minute(day, 3)) for day in _DAYS}
    # a day with a known start is not open where nothing says so, even if its end can't be read
    opened = lambda day, before, m: F.coalesce(S.open_in_week(*span[day], *span[before], F.lit(m)), F.when(span[day][0].isNotNull(), False))
    return d.select("doc_id", *(opened(_DAYS[i], _DAYS[i - 1], m).alias(f"open_{_DAYS[i].lower()}_{m}") for i, m in _PROBES))


_ASKED = "q as (select distinct case_id, lower(query_text) t from seed_queries where query_text is not null)"
_TOKENS = "list_concat(regexp_extract_all({0}, '[a-z0-9]+'), flatten([[substring(r, i, k) for i in range(1, greatest(2, length(r) - k + 2))] for r in regexp_extract_all({0}, '[\\x{{3400}}-\\x{{9fff}}]+') for k in [2, 3] if length(r) >= k]))"


@query(f"""with {BIZ}, {_ASKED}, cat as (select distinct unnest(categories) category from biz), d as (select category, regexp_extract_all(lower(category), '[a-z0-9]+') w from cat where category is not null),
st as (select count(*) n, avg(len(w)) mean from d), tf as (select category, len, term, count(*) f from (select category, len(w) len, unnest(w) term from d) group by all), dfs as (select term, count(*) df from tf group by 1),
qt as (select case_id, term, count(*) k from (select case_id, unnest(regexp_extract_all(t, '[a-z0-9]+')) term from q) group by all),
s as (select case_id, category, sum(k * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * len / mean))) bm from qt join tf using (term) join dfs using (term), st group by all),
al as (select case_id, category from q join d on contains(t, lower(category))), u as (select coalesce(s.case_id, al.case_id) case_id, coalesce(s.category, al.category) category, round(coalesce(bm, 0) + case when al.category is not null then 12 else 0 end, 9) score from s full join al on s.case_id = al.case_id and s.category = al.category)
select case_id, category, score, row_number() over (partition by case_id order by score desc, category) rank from u qualify rank <= 5""")
def category_search(spark: SparkSession, folder: str) -> DataFrame:
    cats = businesses(spark, folder).select(F.explode("categories").alias("category")).where("category is not null").distinct()
    asked = table(spark, folder, "seed_queries", "case_id", "query_text").where("query_text is not null").select("case_id", "query_text").distinct()
    return T.catalogue_search(asked, "case_id", "query_text", cats, "category", 5)


# rankings


@query(f"""with {_QUALITY}, {_QUALITY_ROUTE}, {_TEXT}, s as (select task_id, business_id, 0.6::double / (60 + rank) share from qroute where rank <= 500 union all select task_id, business_id, 0.4::double / (60 + rank) from troute where rank <= 500),
f as (select task_id, business_id, round(sum(share), 9) fusion_score, count(*) route_count, row_number() over (partition by task_id order by round(sum(share), 9) desc, business_id) rank from s group by 1, 2) select task_id, business_id, fusion_score, route_count, rank from f where rank <= 100""")
def dual_channel_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, 100, 500, {"quality": 0.6, "text": 0.4}).select("task_id", "business_id", "fusion_score", "route_count", "rank")


@query(f"""with {_QUALITY}, {_QUALITY_ROUTE}, {_TEXT}, p as (select business_id, count(*) n from inter group by 1), b as (select q.task_id, q.business_id, n, coalesce(t.score, 0.5) t from (select * from qroute where rank <= 20) q left join p using (business_id) left join tscore t using (task_id, business_id))
select task_id, business_id, row_number() over (partition by task_id order by sha256('baseline:' || task_id || ':' || business_id)) random_rank, row_number() over (partition by task_id order by n desc, business_id) popularity_rank, row_number() over (partition by task_id order by t desc, business_id) text_rank from b""")
def baseline_rankers(spark: SparkSession, folder: str) -> DataFrame:
    n = interactions(spark, folder).groupBy("business_id").agg(F.count("*").alias("n"))
    b = _ranked(spark, folder, "quality", 20, texts=True).join(n, "business_id")
    place = lambda *order: F.row_number().over(Window.partitionBy("task_id").orderBy(*order))
    return b.select("task_id", "business_id", place(S.hash_order("baseline", c("task_id"), c("business_id"))).alias("random_rank"), place(c("n").desc(), "business_id").alias("popularity_rank"), place(F.coalesce("text", F.lit(0.5)).desc(), "business_id").alias("text_rank"))


@query("""with a as (select business_id, aspect_id, coalesce(degree, 0) x, coalesce(evidence_sufficiency, 0) y, coalesce(controversy, 0) z from aspect_scores) select business_id, aspect_id, round(x * 0.6::double + y * 0.3::double + z * -0.2::double, 9) score from a""")
def batch_scoring(spark: SparkSession, folder: str) -> DataFrame:
    names = ["degree", "evidence_sufficiency", "controversy"]
    rows = table(spark, folder, "aspect_scores", "business_id", "aspect_id", *names)
    return batch_score(rows, ["business_id", "aspect_id"], names, linear([0.6, 0.3, -0.2])).select("business_id", "aspect_id", F.round("score", 9).alias("score"))


_SETS = "list_distinct(regexp_extract_all(lower(segment_text), '[a-z0-9]+'))"


@query(f"""with s as (select distinct segment_id, review_id, segment_index, {_SETS} w from review_segments where review_id is not null and segment_text is not null),
p as (select segment_id, lead(segment_id) over o next_id, w, lead(w) over o v from s window o as (partition by review_id order by segment_index, segment_id))
select segment_id, next_id, round(len(list_intersect(w, v)) / nullif(len(list_distinct(list_concat(w, v))), 0)::double, 9) score from p where next_id is not null""")
def pair_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """A pair scorer as a plug-in, here the overlap of words, on neighbouring passages."""
    s = table(spark, folder, "review_segments", "segment_id", "review_id", "segment_index", "segment_text").where("review_id is not null and segment_text is not null").distinct()
    o = Window.partitionBy("review_id").orderBy("segment_index", "segment_id")  # the passages of one review
    pairs = s.select("segment_id", F.lead("segment_id").over(o).alias("next_id"), "segment_text", F.lead("segment_text").over(o).alias("next_text")).where("next_id is not null")
    return score_pairs(pairs, ["segment_id", "next_id"], "segment_text", "next_text", T.word_overlap).select("segment_id", "next_id", F.round("score", 9).alias("score"))


@query("""select segment_id, length(segment_text)::double chars, (length(segment_text) - length(replace(segment_text, 'e', '')))::double es, (length(segment_text) - length(replace(segment_text, ' ', '')))::double blanks
from (select distinct segment_id, segment_text from review_segments where segment_text is not null)""")
def cached_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """An encoder as a plug-in behind the vector cache."""
    rows = table(spark, folder, "review_segments", "segment_id", "segment_text").where("segment_text is not null").distinct()
    cache = X.VectorCache(spark, scratch_path(spark, "vectors"))
    coded = cache.encode(rows, "segment_text", lambda texts: [[len(t), t.count("e"), t.count(" ")] for t in texts])
    return coded.select("segment_id", *(F.element_at("vector", i + 1).cast("double").alias(n) for i, n in enumerate(("chars", "es", "blanks"))))


# conditions and evidence

_CONDITIONS = """cond as (select distinct case_id, x.field, x.operator, x.importance from (select case_id, unnest(from_json(expected_conditions, '[{"field":"VARCHAR","operator":"VARCHAR","importance":"VARCHAR"}]')) x from seed_queries where expected_conditions is not null))"""


def _conditions(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("expected_conditions", "array<struct<field:string,operator:string,importance:string>>")
    return table(spark, folder, "seed_queries", "case_id", "expected_conditions").select("case_id", F.explode(parsed).alias("x")).select("case_id", "x.field", "x.operator", "x.importance").distinct()


@query(f"with {_CONDITIONS} select field, importance, count(*) n_conditions, count(distinct case_id) n_cases from cond group by 1, 2")
def condition_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _conditions(spark, folder).groupBy("field", "importance").agg(F.count("*").alias("n_conditions"), F.countDistinct("case_id").alias("n_cases"))


_FACTS = "facts as (select aspect_id, count(distinct business_id) filter (usable_for_ranking and degree >= 0.5) n_satisfied, count(distinct business_id) filter (usable_for_ranking and degree < 0.5) n_failed from aspect_scores group by 1)"


@query(f"""with {BIZ}, {_CONDITIONS}, {_FACTS} select case_id, field, coalesce(n_satisfied, 0) n_satisfied, coalesce(n_failed, 0) n_failed, (select count(*) from biz) - coalesce(n_satisfied, 0) - coalesce(n_failed, 0) n_unknown from cond left join facts on field = aspect_id""")
def condition_satisfaction(spark: SparkSession, folder: str) -> DataFrame:
    """How many businesses hold, fail or leave open each condition by its aspect; an unknown never satisfies."""
    usable = c("usable_for_ranking")
    held = lambda test: F.countDistinct(F.when(usable & test, c("business_id")))
    facts = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "degree", "usable_for_ranking").groupBy(c("aspect_id").alias("field")).agg(held(c("degree") >= 0.5).alias("yes"), held(c("degree") < 0.5).alias("no"))
    total = businesses(spark, folder).agg(F.count("*").alias("n"))  # one row
    yes, no = F.coalesce("yes", F.lit(0)), F.coalesce("no", F.lit(0))
    return _conditions(spark, folder).join(facts, "field", "left").crossJoin(F.broadcast(total)).select("case_id", "field", yes.alias("n_satisfied"), no.alias("n_failed"), (c("n") - yes - no).alias("n_unknown"))


@query(f"""with {BIZ}, f as (select distinct aspect_id from aspect_scores), a as (select business_id, aspect_id, bool_or(usable_for_ranking) u, max(case when usable_for_ranking then ranking_degree end) d from aspect_scores group by 1, 2)
select biz.business_id, f.aspect_id, case when coalesce(u, false) and d is not null then 'known' else 'unknown' end as status, coalesce(d, 0.5) degree from biz join f on true left join a on a.business_id = biz.business_id and a.aspect_id = f.aspect_id""")
def offline_aspect_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Stored scores of every business for the few aspects there are; what is not usable is unknown and neutral."""
    rows = table(spark, folder, "aspect_scores", "business_id", "aspect_id", "usable_for_ranking", "ranking_degree")
    aspects = rows.agg(F.array_sort(F.collect_set("aspect_id")).alias("aspects"))  # one row, an entry an aspect
    wanted = businesses(spark, folder).select("business_id").crossJoin(F.broadcast(aspects)).select("business_id", F.explode("aspects").alias("aspect_id"))
    held = rows.groupBy("business_id", "aspect_id").agg(F.max(F.when(c("usable_for_ranking"), c("ranking_degree"))).alias("d"))
    return wanted.join(held, ["business_id", "aspect_id"], "left").select("business_id", "aspect_id", F.when(c("d").isNotNull(), "known").otherwise("unknown").alias("status"), F.coalesce("d", F.lit(0.5)).alias("degree"))


@query("""with h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all), own as (select point_id, min(business_id) business_id from review_segments where business_id is not null group by 1),
r as (select case_id, business_id, score, row_number() over (partition by case_id, business_id order by score desc, point_id) k from h join own using (point_id)), g as (select case_id, business_id, max(score) best, min(score) last, count(*) n from r where k <= 5 group by 1, 2)
select case_id, business_id, round(best, 9) best, round(last, 9) last from g where n = 5 and best - last < 0.1""")
def adaptive_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Businesses whose five places are full but whose scores are too close to be clear: a wider search is asked for these."""
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    own = table(spark, folder, "review_segments", "point_id", "business_id").where("business_id is not null").groupBy("point_id").agg(F.min("business_id").alias("business_id"))
    ranked = h.join(own, "point_id").withColumn("k", F.row_number().over(Window.partitionBy("case_id", "business_id").orderBy(c("score").desc(), "point_id"))).where("k <= 5")
    g = ranked.groupBy("case_id", "business_id").agg(F.max("score").alias("best"), F.min("score").alias("last"), F.count("*").alias("n"))
    return g.where("n = 5 and best - last < 0.1D").select("case_id", "business_id", F.round("best", 9).alias("best"), F.round("last", 9).alias("last"))


_END = "timestamp '2025-01-01'"


@query(f"""with {INTER}, {BIZ}, w as (select user_id, latitude, longitude, stars * pow(0.5, (epoch_us({_END}) - epoch_us(t)) / 86400000000.0::double / 365) w from inter join biz using (business_id) where latitude is not null and longitude is not null and t < {_END})
select user_id, round(sum(w * latitude) / sum(w), 6) lat, round(sum(w * longitude) / sum(w), 6) lon, count(*) n from w group by 1""")
def weighted_centroids(spark: SparkSession, folder: str) -> DataFrame:
    end = F.lit("2025-01-01").cast("timestamp_ntz")
    placed = businesses(spark, folder).where("latitude is not null and longitude is not null").select("business_id", "latitude", "longitude")
    rows = interactions(spark, folder).where(c("t") < end).join(placed, "business_id").withColumn("w", c("stars") * S.half_life_weight(S.age_days(c("t"), end), 365.0))
    mean = lambda x: F.round(F.sum(c("w") * c(x)) / F.sum("w"), 6)
    return rows.groupBy("user_id").agg(mean("latitude").alias("lat"), mean("longitude").alias("lon"), F.count("*").alias("n"))


# audits, sampling and metrics


@query("""with r as (select review_id, min(business_id) b, min(user_id) u, min(review_time) t from reviews where review_id is not null group by 1), s as (select distinct segment_id, review_id, business_id, user_id, review_time from review_segments),
j as (select case when r.review_id is null then 'no_review' when s.business_id <> b then 'business' when s.user_id <> u then 'user' when s.review_time <> t then 'time' when s.business_id is null or b is null or s.review_time is null then 'unknown' else 'ok' end as finding from s left join r using (review_id))
select finding, count(*) n from j group by 1""")
def event_lineage_audit(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reviews", "review_id", "business_id", "user_id", "review_time").where("review_id is not null").groupBy("review_id").agg(F.min("business_id").alias("b"), F.min("user_id").alias("u"), F.min("review_time").alias("t"), F.lit(True).alias("there"))
    s = table(spark, folder, "review_segments", "segment_id", "review_id", "business_id", "user_id", "review_time").distinct()
    j = s.join(r, "review_id", "left")
    finding = F.when(c("there").isNull(), "no_review").when(c("business_id") != c("b"), "business").when(c("user_id") != c("u"), "user").when(c("review_time") != c("t"), "time").when(c("business_id").isNull() | c("b").isNull() | c("review_time").isNull(), "unknown").otherwise("ok")
    return j.groupBy(finding.alias("finding")).agg(F.count("*").alias("n"))


@query("""with l as (select sha256(d.text) h, min(page_label) label from page_labels p join documents d using (doc_id) where page_label <> 'unsure' and d.text is not null group by 1 having count(distinct page_label) = 1)
select doc_id, label, not exists (select 1 from page_labels p where p.doc_id = documents.doc_id) reused from documents join l on sha256(text) = h""")
def label_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Labels carried over to documents of the same text, where the labels of that text agree."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    labels = table(spark, folder, "page_labels", "doc_id", "page_label")
    known = docs.join(labels.where("page_label <> 'unsure'"), "doc_id").groupBy("h").agg(F.min("page_label").alias("label"), F.countDistinct("page_label").alias("k")).where("k = 1")
    own = labels.select("doc_id", F.lit(True).alias("own")).distinct()
    return docs.join(known, "h").join(own, "doc_id", "left").select("doc_id", "label", c("own").isNull().alias("reused"))


@query(f"""with {INTER}, g as (select user_id, stars s, count(*) n from inter group by 1, 2), tr as (select range trial from range(16)),
a as (select trial, user_id, ('0x' || substr(sha256('split:' || trial || ':' || user_id), 1, 8))::bigint / 4294967296.0::double u from tr, (select distinct user_id from g)),
p as (select trial, user_id, case when u < 0.8 then 'train' when u < 0.9 then 'validation' else 'test' end part from a), k as (select trial, part, s, sum(n) n from p join g using (user_id) group by 1, 2, 3),
sh as (select s, sum(n) / (select sum(n) from g) share from g group by 1), tot as (select trial, part, sum(n) t from k group by 1, 2),
dev as (select trial, round(sum(abs(coalesce(k.n, 0) / t - share)), 9) d from tot cross join sh left join k using (trial, part, s) group by 1),
best as (select trial, d from dev order by d, trial limit 1) select user_id, part, d deviation from p join best using (trial)""")
def grouped_split_search(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split(interactions(spark, folder), "user_id", "stars", {"train": 0.8, "validation": 0.1, "test": 0.1}, trials=16)


@query("""with s as (select segment_id, min(segment_text) t, max(coalesce(useful, 0)) useful from review_segments where segment_text is not null and segment_id is not null group by 1),
b as (select *, least(2, len(regexp_extract_all(lower(t), 'parking|terrace|booth|counter|patio'))) bucket from s) select segment_id, bucket, row_number() over (partition by bucket order by useful desc, length(t) desc, segment_id) k from b qualify k <= 40""")
def teacher_sampling(spark: SparkSession, folder: str) -> DataFrame:
    """The 40 best passages of each bucket of how many terms they name."""
    s = table(spark, folder, "review_segments", "segment_id", "segment_text", "useful").where("segment_text is not null and segment_id is not null").groupBy("segment_id").agg(F.min("segment_text").alias("t"), F.max(F.coalesce("useful", F.lit(0))).alias("useful"))
    hits = F.size(F.regexp_extract_all(F.lower("t"), F.lit("parking|terrace|booth|counter|patio"), F.lit(0)))
    w = Window.partitionBy("bucket").orderBy(c("useful").desc(), F.length("t").desc(), "segment_id")
    return s.withColumn("bucket", F.least(F.lit(2), hits)).withColumn("k", F.row_number().over(w)).where("k <= 40").select("segment_id", "bucket", "k")


_HITS = "h as (select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) and case_id is not null group by all), st as (select point_id, max(stars) stars from review_segments group by 1)"


@query(f"""with {_HITS}, r as (select case_id, point_id, row_number() over (partition by case_id order by score desc, point_id) rank from h), rel as (select distinct case_id, point_id from h join st using (point_id) where stars >= 4),
n as (select case_id, count(*) n from rel group by 1), x as (select case_id, count(*) filter (rank <= 5) hits, min(rank) first, sum(case when rank <= 5 then 1 / log2(rank + 1) else 0 end) dcg from r join rel using (case_id, point_id) group by 1)
select case_id, coalesce(hits, 0) hits, round(coalesce(1.0::double / first, 0), 9) mrr, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(n, 5) + 1)]), 9) ndcg from n left join x using (case_id)""")
def multi_relevant_metrics(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score) and case_id is not null").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    st = table(spark, folder, "review_segments", "point_id", "stars").groupBy("point_id").agg(F.max("stars").alias("stars"))
    ranking = h.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(c("score").desc(), "point_id")))
    return M.multi_relevant(ranking, h.join(st, "point_id").where("stars >= 4"), "case_id", "point_id")


@query(f"""with {TASKS}, k as (select split, sum(case when history_count >= 8 then 1 else 0 end) a, sum(case when history_count >= 3 then 1 else 0 end) b from tasks group by 1)
select split, case when a is null or b is null then 'unavailable' when b = 0 then 'not_applicable' else 'measured' end as status, round(a / nullif(b, 0)::double, 9) v from k""")
def metric_status(spark: SparkSession, folder: str) -> DataFrame:
    k = tasks(spark, folder).groupBy("split").agg(F.sum(F.when(c("history_count") >= 8, 1).otherwise(0)).alias("a"), F.sum(F.when(c("history_count") >= 3, 1).otherwise(0)).alias("b"))
    return k.select("split", M.with_status(c("a"), c("b")).alias("m")).select("split", "m.status", c("m.value").alias("v"))


@query(f"""with {INTER}, x as (select review_id, round(1 / (1 + exp(-(stars - 3 + ((epoch_us(t) // 1000000) % 1000) / 1000.0::double))), 6) p, (stars >= 4)::int o from inter), r as (select *, row_number() over (order by p desc, review_id) i, count(*) over () n from x),
pts as (select unnest([0.1, 0.25, 0.5, 0.75, 1.0])::double coverage) select coverage, count(*) n, round(1 - avg(o), 9) risk from r join pts on i <= ceil(coverage * n) group by 1""")
def coverage_risk(spark: SparkSession, folder: str) -> DataFrame:
    second = F.pmod(F.floor(S.micros(c("t")) / 1_000_000), F.lit(1000)) / 1000.0
    x = interactions(spark, folder).select("review_id", F.round(1 / (1 + F.exp(-(c("stars") - 3 + second))), 6).alias("p"), (c("stars") >= 4).cast("int").alias("o"))
    return M.coverage_risk(x, "p", "o", ["review_id"], (0.1, 0.25, 0.5, 0.75, 1.0))
