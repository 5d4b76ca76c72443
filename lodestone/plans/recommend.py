"""Splits, routes, fusion and rankings on the review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import retrieval as R
from lodestone.operators.catalogue import Catalogue, candidates, catalogue, negatives, text_weights
from lodestone.operators.splits import leave_last_two_out, rolling_targets
from lodestone.plans.base import BIZ, INTER, TASKS, businesses, interactions, tasks

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


@query(f"""with {INTER}, p as (select *, row_number() over w as pos, count(*) over (partition by user_id) n, lag(t) over w pt from inter window w as (partition by user_id order by t, review_id))
select user_id, case when pos = n then 'test' else 'validation' end split, review_id, business_id, t cutoff_time, pos - 1 history_count, pt history_max_time, pt = t tie from p where n >= 3 and pos >= n - 1""")
def temporal_split_last_two(spark: SparkSession, folder: str) -> DataFrame:
    return leave_last_two_out(interactions(spark, folder))


@query(f"""with {INTER}, k as (select distinct task_id, user_id, cutoff_time, history_count, history_max_time from temporal_contexts),
h as (select k.task_id, count(i.review_id) n, max(i.t) mx from k left join inter i on i.user_id = k.user_id and i.t < k.cutoff_time group by 1)
select k.task_id, k.history_count = h.n count_holds, k.history_max_time is not distinct from h.mx time_holds, k.history_max_time < k.cutoff_time strict from k join h using (task_id)""")
def split_integrity_audit(spark: SparkSession, folder: str) -> DataFrame:
    from lodestone.sources.tables import table

    k = table(spark, folder, "temporal_contexts", "task_id", "user_id", "cutoff_time", "history_count", "history_max_time").distinct()
    h = R.history_of(k, interactions(spark, folder)).groupBy("task_id").agg(F.count("*").alias("n"), F.max("t").alias("mx"))
    return k.join(h, "task_id", "left").select("task_id", (c("history_count") == F.coalesce("n", F.lit(0))).alias("count_holds"), c("history_max_time").eqNullSafe(c("mx")).alias("time_holds"), (c("history_max_time") < c("cutoff_time")).alias("strict"))


@query(f"""with {INTER}, p as (select user_id, review_id, t, row_number() over w - 1 p, count(*) over (partition by user_id) n, lag(t) over w pt from inter window w as (partition by user_id order by t, review_id)),
safe as (select *, p - row_number() over (partition by user_id order by p) run from p where p >= 8 and p + 1 <= n - 2 and pt < t),
s as (select *, (p - min(p) over (partition by user_id, run)) % 2 = 0 spaced, max(p) over (partition by user_id) last from safe),
s2 as (select *, max(p) filter (spaced) over (partition by user_id) last_spaced from s),
s3 as (select *, row_number() over (partition by user_id order by p) - 1 i, count(*) over (partition by user_id) m from s2 where (spaced and p <> last_spaced) or p = last),
s4 as (select * from s3 where m <= 6 or list_contains([round_even(j * (m - 1) / 5.0::double, 0) for j in range(6)], i::double))
select user_id, review_id, p target_position, row_number() over (partition by user_id order by p) k, count(*) over (partition by user_id) n_targets,
 round(case when count(*) over (partition by user_id) = 1 then 1.0::double else 0.5::double + 0.5::double * (row_number() over (partition by user_id order by p) - 1) / (count(*) over (partition by user_id) - 1) end, 9) sample_weight from s4""")
def rolling_training_targets(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_targets(interactions(spark, folder))


_QUALITY = f"""{INTER}, {BIZ}, {TASKS}, cut as (select distinct cutoff_time from tasks),
counts as (select cutoff_time, b.business_id, count(*) n, sum(stars) s from cut, inter i join biz b using (business_id) where i.t < cutoff_time group by all),
scale as (select cutoff_time, sum(s) / sum(n) mean, quantile_cont(ln(1 + n::double), 0.95) p95 from counts group by 1),
quality as (select cutoff_time, business_id, n, round(0.8 * greatest(0.0, least(1.0, ((s + 20 * mean) / (n + 20) - 1) / 4)) + 0.2 * case when p95 > 0 then least(ln(1 + n::double), p95) / p95 else 0 end, 9) quality from counts join scale using (cutoff_time)),
hist as (select k.task_id, i.business_id, i.stars, i.t from tasks k join inter i on i.user_id = k.user_id and i.t < k.cutoff_time)"""
_QUALITY_ROUTE = """qroute as (select k.task_id, q.business_id, q.quality score, row_number() over (partition by k.task_id order by q.quality desc, q.business_id) rank
 from tasks k join quality q using (cutoff_time) where not exists (select 1 from hist h where h.task_id = k.task_id and h.business_id = q.business_id))"""


def _described(spark: SparkSession, folder: str) -> DataFrame:
    """(business_id, doc): name and categories as one text."""
    cats = F.coalesce(F.array_join(F.array_sort(F.array_compact("categories")), " "), F.lit(""))
    return businesses(spark, folder).select("business_id", F.concat_ws(" ", F.coalesce("name", F.lit("")), cats).alias("doc"))


def _known(spark: SparkSession, folder: str, text: bool) -> Catalogue:
    return catalogue(businesses(spark, folder), text_weights(_described(spark, folder), "doc") if text else None)


def _ranked(spark: SparkSession, folder: str, by: str, n: int, per_route: int = 500, weights: dict[str, float] | None = None, texts: bool = False, **more) -> DataFrame:  # noqa: ANN003
    """The first ``n`` businesses of each task by a route or by fused routes, with all their uncut scores; that of the text only where it is used or asked for."""
    text = texts or by == "text" or "text" in (weights or {}) or "text" in more.get("also", ())
    return candidates(interactions(spark, folder), tasks(spark, folder), _known(spark, folder, text), by, n, per_route, weights, **more)


_ROUTE = ("task_id", "business_id", "score", "rank")


def _quality_route(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return _ranked(spark, folder, "quality", n, shown=()).select(*_ROUTE)


@query(f"with {_QUALITY}, {_QUALITY_ROUTE} select task_id, business_id, score, rank from qroute where rank <= 20")
def as_of_quality_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _quality_route(spark, folder, 20)


_CATEGORY = """tag as (select distinct business_id, unnest(categories) category from biz),
seen as (select task_id, category, count(*) n, sum(stars) s from hist join tag using (business_id) where category is not null group by 1, 2),
aff as (select task_id, category, 0.7::double * ((s / n - 1) / 4) + 0.3::double * n / max(n) over (partition by task_id) a from seen),
croute as (select task_id, business_id, round(max(a), 9) score, row_number() over (partition by task_id order by round(max(a), 9) desc, business_id) rank from aff join tag using (category) group by 1, 2 having max(a) > 0)"""


def _category_route(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return _ranked(spark, folder, "category", n, shown=()).select(*_ROUTE)


@query(f"with {_QUALITY}, {_CATEGORY} select task_id, business_id, score, rank from croute where rank <= 20")
def category_affinity_route(spark: SparkSession, folder: str) -> DataFrame:
    return _category_route(spark, folder, 20)


_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2)))))"
_LOCATION = f"""centre as (select task_id, round(avg(latitude), 6) lat, round(avg(longitude), 6) lon from hist join biz using (business_id) where latitude is not null and longitude is not null group by 1),
dist as (select task_id, business_id, {_KM} km from centre, biz where latitude is not null and longitude is not null),
lroute as (select task_id, business_id, round(km, 6) km, round(exp(-km / 10), 9) score, row_number() over (partition by task_id order by round(exp(-km / 10), 9) desc, business_id) rank from dist)"""


def _location_route(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return _ranked(spark, folder, "location", n, shown=()).select("task_id", "business_id", F.round("km", 6).alias("km"), "score", "rank")


@query(f"with {_QUALITY}, {_LOCATION} select task_id, business_id, score, rank from lroute where rank <= 20")
def location_affinity_route(spark: SparkSession, folder: str) -> DataFrame:
    return _location_route(spark, folder, 20).select("task_id", "business_id", "score", "rank")


_ROUTES = f"{_QUALITY}, {_QUALITY_ROUTE}, {_CATEGORY}, {_LOCATION}"
#: Rows of each route that are fused, and kept of the fused list. The queries without a number in their name fuse 50 a route, as their SQL says.
PER_ROUTE = 500


def _fused_sql(per_route: int) -> str:
    return f"""shares as (select task_id, business_id, 1.0::double / (60 + rank) share from qroute where rank <= {per_route} union all select task_id, business_id, 1.0::double / (60 + rank) from croute where rank <= {per_route}
 union all select task_id, business_id, 0.5::double / (60 + rank) from lroute where rank <= {per_route}),
fused as (select task_id, business_id, round(sum(share), 9) fusion_score, count(*) route_count, row_number() over (partition by task_id order by round(sum(share), 9) desc, business_id) rank from shares group by 1, 2)"""


_FUSED, _FUSED_500 = _fused_sql(50), _fused_sql(PER_ROUTE)


_THREE = {"quality": 1.0, "category": 1.0, "location": 0.5}


def _fused(spark: SparkSession, folder: str, n: int, per_route: int = PER_ROUTE, weights: dict[str, float] | None = None, **more) -> DataFrame:  # noqa: ANN003
    return _ranked(spark, folder, "fused", n, per_route, weights or _THREE, **more).withColumnRenamed("score", "fusion_score")


_LISTED = ("task_id", "business_id", "fusion_score", "route_count", "rank")


@query(f"with {_ROUTES}, {_FUSED} select task_id, business_id, fusion_score, route_count, rank from fused where rank <= 30")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, 30, 50, shown=()).select(*_LISTED)


@query(f"with {_ROUTES}, {_FUSED_500} select task_id, business_id, fusion_score, route_count, rank from fused where rank <= {PER_ROUTE}")
def rrf_fusion_500(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder, PER_ROUTE, shown=()).select(*_LISTED)


_TEXT = r"""docs as (select business_id, regexp_extract_all(lower(concat_ws(' ', coalesce(name, ''), coalesce(array_to_string(list_sort([x for x in categories if x is not null]), ' '), ''))), '[\p{L}\p{N}]+') w from biz),
tm as (select business_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) term from docs), tf as (select business_id, term, count(*) f from tm group by all),
dfs as (select term, count(*) df from tf group by 1 having count(*) >= 2), nn as (select count(*) n from docs), raw as (select business_id, term, (1 + ln(f)) * (ln((1 + n) / (1 + df)::double) + 1) w from tf join dfs using (term), nn),
tw as (select business_id, term, w / sqrt(sum(w * w) over (partition by business_id)) w from raw),
cen as (select task_id, term, sum(w) filter (stars >= 4) p, sum(w) filter (stars <= 2) q from hist join tw using (business_id) group by 1, 2), nrm as (select task_id, sqrt(sum(p * p)) np, sqrt(sum(q * q)) nq from cen group by 1),
cs as (select c.task_id, t.business_id, sum(c.p * t.w) a, sum(c.q * t.w) b from cen c join tw t using (term) group by 1, 2),
tscore as (select task_id, business_id, round(greatest(0.0, least(1.0, 0.5::double + 0.5::double * coalesce(a / np, 0) - 0.5::double * coalesce(b / nq, 0))), 9) score
 from nrm cross join (select distinct business_id from tw) left join cs using (task_id, business_id) where np is not null or nq is not null),
troute as (select *, row_number() over (partition by task_id order by score desc, business_id) rank from tscore)"""


@query(f"with {_QUALITY}, {_TEXT} select task_id, business_id, score, rank from troute where rank <= 20")
def text_preference_route(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder, "text", 20, shown=()).select(*_ROUTE)


_FUSED_FOUR = _FUSED_500.replace("0.5::double / (60 + rank)", "1.0::double / (60 + rank)").replace(f"from lroute where rank <= {PER_ROUTE}", f"from lroute where rank <= {PER_ROUTE} union all select task_id, business_id, 1.0::double / (60 + rank) from troute where rank <= {PER_ROUTE}")
_FOUR = {"quality": 1.0, "category": 1.0, "location": 1.0, "text": 1.0}


@query(f"with {_ROUTES}, {_TEXT}, {_FUSED_FOUR} select task_id, business_id, fusion_score, route_count, rank from fused where rank <= {PER_ROUTE}")
def four_route_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Quality, category, location and text, 500 a route with equal weights, 500 kept."""
    return _fused(spark, folder, PER_ROUTE, PER_ROUTE, _FOUR, shown=()).select(*_LISTED)


@query(f"""with {_ROUTES} select coalesce(q.task_id, x.task_id) task_id, coalesce(q.business_id, x.business_id) business_id, q.task_id is not null in_base, x.task_id is not null in_extra
from (select * from qroute where rank <= 30) q full join (select * from croute where rank <= 30) x on q.task_id = x.task_id and q.business_id = x.business_id
where not exists (select 1 from hist h where h.task_id = coalesce(q.task_id, x.task_id) and h.business_id = coalesce(q.business_id, x.business_id))""")
def protected_union(spark: SparkSession, folder: str) -> DataFrame:
    return _protected(spark, folder, 30)


@query(SQL["protected_union"].replace("rank <= 30", f"rank <= {PER_ROUTE}"))
def protected_union_500(spark: SparkSession, folder: str) -> DataFrame:
    return _protected(spark, folder, PER_ROUTE)


def _protected(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """Both lists of a task come from one walk, which also knows its history, so nothing is joined."""
    both = _ranked(spark, folder, "quality", n, shown=(), also={"category": n}).where("not seen")
    return both.select("task_id", "business_id", c("rank").isNotNull().alias("in_base"), c("category_rank").isNotNull().alias("in_extra"))


_LATEST = """latest as (select user_id, business_id, max_by(stars, (t, review_id)) stars, max(t) t from inter group by 1, 2),
rated as (select user_id, business_id, case when stars >= 4 then 'positive' else 'negative' end feedback, pow(0.5, (epoch_us((select max(t) from inter)) - epoch_us(t)) / 86400000000.0::double / 365) w from latest where stars >= 4 or stars <= 2),
pop as (select feedback, business_id, sum(w) p from rated group by 1, 2),
pairs as (select a.feedback, a.business_id i, b.business_id j, sum(sqrt(a.w * b.w)) co, count(*) support from rated a join rated b on a.user_id = b.user_id and a.feedback = b.feedback and a.business_id < b.business_id group by all),
sims as (select feedback, i, j, round(co, 9) cooccurrence, support, round(co / sqrt(x.p * y.p) * support / (support + 10), 9) similarity from pairs join pop x using (feedback) join pop y using (feedback) where x.business_id = i and y.business_id = j)"""


@query(f"with {INTER}, {_LATEST} select feedback, i, j, cooccurrence, support, similarity from sims")
def item_knn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return R.item_pairs(interactions(spark, folder))


@query(f"""with {INTER}, {_LATEST}, both_ways as (select feedback, i, j, similarity from sims union all select feedback, j, i, similarity from sims),
mass as (select user_id, feedback, j, sum(w * similarity) m from rated join both_ways using (feedback) where business_id = i group by all), total as (select user_id, feedback, sum(w) t from rated group by all)
select user_id, j business_id, round(coalesce(max(m / t) filter (feedback = 'positive'), 0), 9) positive_score, round(coalesce(max(m / t) filter (feedback = 'negative'), 0), 9) negative_score
from mass join total using (user_id, feedback) where not exists (select 1 from latest l where l.user_id = mass.user_id and l.business_id = mass.j) group by 1, 2""")
def item_knn_scores(spark: SparkSession, folder: str) -> DataFrame:
    events = interactions(spark, folder)
    return R.item_scores(events, R.item_pairs(events))


@query(f"""with {_ROUTES}, b as (select q.task_id, q.business_id, q.score q, coalesce(x.score, 0) x from (select * from qroute where rank <= 50) q left join croute x using (task_id, business_id)),
p as (select *, row_number() over (partition by task_id order by q desc, business_id) rq, row_number() over (partition by task_id order by x desc, business_id) rx, count(*) over (partition by task_id) n from b),
bl as (select task_id, business_id, round(0.7::double * case when n <= 1 then 1.0 else (n - rq)::double / (n - 1) end + (1 - 0.7::double) * case when n <= 1 then 1.0 else (n - rx)::double / (n - 1) end, 9) blend from p)
select task_id, business_id, blend, row_number() over (partition by task_id order by blend desc, business_id) rank from bl""")
def blend_percentile_rank(spark: SparkSession, folder: str) -> DataFrame:
    both = _ranked(spark, folder, "quality", 50).select("task_id", "business_id", c("score").alias("q"), F.coalesce("category", F.lit(0.0)).alias("x"))
    return R.blend(both, "task_id", "business_id", "q", "x", 0.7).select("task_id", "business_id", "blend", "rank")


@query(f"""with {_ROUTES}, {_FUSED}, v as (select k.task_id, i.business_id target from tasks k join inter i on i.user_id = k.user_id and i.t = k.cutoff_time),
hard as (select task_id, business_id, 'hard' negative_kind, row_number() over (partition by task_id order by rank) o from fused f where rank <= 50 and not exists (select 1 from v where v.task_id = f.task_id and v.target = f.business_id)),
h as (select * from hard where o <= 10),
simq as (select x.task_id, x.business_id, 'similar' negative_kind, row_number() over (partition by x.task_id order by x.score desc, x.business_id) o from croute x where rank <= 50 and not exists (select 1 from v where v.task_id = x.task_id and v.target = x.business_id) and not exists (select 1 from h where h.task_id = x.task_id and h.business_id = x.business_id)),
s as (select * from simq where o <= 5),
ranq as (select x.task_id, x.business_id, 'random' negative_kind, row_number() over (partition by x.task_id order by sha256('negative:' || x.task_id || ':' || x.business_id)) o from qroute x where rank <= 200 and not exists (select 1 from v where v.task_id = x.task_id and v.target = x.business_id)
 and not exists (select 1 from h where h.task_id = x.task_id and h.business_id = x.business_id) and not exists (select 1 from s where s.task_id = x.task_id and s.business_id = x.business_id))
select task_id, business_id, negative_kind, o selection_order from h union all select * from s union all select * from ranq where o <= 5""")
def hard_similar_random_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return _negatives(spark, folder, 50, 50, 200)


@query(SQL["hard_similar_random_negatives"].replace(_FUSED, _FUSED_500).replace("from fused f where rank <= 50", f"from fused f where rank <= {PER_ROUTE}").replace("from croute x where rank <= 50", f"from croute x where rank <= {PER_ROUTE}").replace("from qroute x where rank <= 200", f"from qroute x where rank <= {PER_ROUTE}"))
def hard_similar_random_negatives_500(spark: SparkSession, folder: str) -> DataFrame:
    return _negatives(spark, folder, PER_ROUTE, PER_ROUTE, PER_ROUTE)


def _negatives(spark: SparkSession, folder: str, n_hard: int, n_similar: int, n_random: int) -> DataFrame:
    target = tasks(spark, folder).join(interactions(spark, folder).withColumnRenamed("t", "cutoff_time"), ["user_id", "cutoff_time"]).select("task_id", "business_id")
    return negatives(interactions(spark, folder), tasks(spark, folder), _known(spark, folder, False), target, n_hard, n_similar, n_random, n_hard, _THREE)


@query(f"""with {BIZ}, d as (select business_id, rating, review_count, price_level, case when outdoor_seating then 1.0 when outdoor_seating is false then 0.0 end s1, case noise_level when 'quiet' then 1.0 when 'average' then 0.6 when 'loud' then 0.2 when 'very_loud' then 0.0 end s2, (rating - 1) / 4 s3 from biz)
select business_id, round(exp((0.8::double * ln(greatest(coalesce(s1, 0.5), 0.05)) + 0.6::double * 0.75::double * ln(greatest(coalesce(s2, 0.5), 0.05)) + 1.0::double * 0.5625::double * ln(greatest(coalesce(s3, 0.5), 0.05))) / (0.8::double + 0.6::double * 0.75::double + 0.5625::double)), 9) score from d""")
def geometric_soft_rank(spark: SparkSession, folder: str) -> DataFrame:
    noise = F.expr("case noise_level when 'quiet' then 1.0D when 'average' then 0.6D when 'loud' then 0.2D when 'very_loud' then 0.0D end")
    outdoor = F.when(c("outdoor_seating"), 1.0).when(~c("outdoor_seating"), 0.0)
    preferences = [(outdoor, 0.8, 1), (noise, 0.6, 2), ((c("rating") - 1) / 4, 1.0, 3)]
    weights = [strength * 0.75 ** (priority - 1) for _, strength, priority in preferences]
    logs = sum((w * F.log(F.greatest(F.coalesce(s, F.lit(0.5)), F.lit(0.05))) for (s, _, _), w in zip(preferences, weights)), F.lit(0.0))
    return businesses(spark, folder).select("business_id", F.round(F.exp(logs / sum(weights)), 9).alias("score"))


@query(f"""with {BIZ} select city, business_id, row_number() over (partition by city order by coalesce(outdoor_seating, false) desc, coalesce(price_level <= 2, false) desc, rating desc nulls last, review_count desc nulls last, business_id) rank from biz""")
def layered_rank(spark: SparkSession, folder: str) -> DataFrame:
    order = R.layered_order((F.coalesce("outdoor_seating", F.lit(False)), True), (F.coalesce(c("price_level") <= 2, F.lit(False)), True), (c("rating"), True), (c("review_count"), True), (c("business_id"), False))
    return businesses(spark, folder).select("city", "business_id", F.row_number().over(Window.partitionBy("city").orderBy(*order)).alias("rank"))


@query()
def bounded_reorder(spark: SparkSession, folder: str) -> DataFrame:
    fused = _fused(spark, folder, 30).withColumn("semantic", F.conv(F.substring(S.hash_order("semantic", c("task_id"), c("business_id")), 1, 8), 16, 10).cast("double"))
    return R.bounded_reorder(fused, "task_id", "business_id", "rank", "semantic")


_MIX = "round(fusion_score * 20 + ('0x' || substr(sha256('mix:' || task_id || ':' || business_id), 1, 8))::bigint / 4294967296.0::double, 9)"


@query(f"""with {_ROUTES}, {_FUSED_500}, m as (select task_id, business_id, rank base_rank, route_count >= 2 e, {_MIX} s from fused where rank <= 30),
r as (select *, row_number() over (partition by task_id order by s desc, business_id) new_rank from m),
x as (select *, row_number() over (partition by task_id order by s, business_id) k from r where new_rank <= 3 and base_rank > 3), l as (select *, row_number() over (partition by task_id order by base_rank) k from r where new_rank > 3 and base_rank <= 3),
a1 as (select l.task_id, l.k, l.business_id mine, l.new_rank mr, x.business_id other, x.new_rank xr, not (x.s - l.s >= 0.2 and x.e) swap from l join x on l.task_id = x.task_id and l.k = 1 and x.k = 1),
a2 as (select l.task_id, l.k, l.business_id mine, l.new_rank mr, x.business_id other, x.new_rank xr, not (x.s - l.s >= 0.2 and x.e) swap, a1.swap::int + 1 j from l join a1 using (task_id) join x on l.task_id = x.task_id and l.k = 2 and x.k = a1.swap::int + 1),
a3 as (select l.task_id, l.k, l.business_id mine, l.new_rank mr, x.business_id other, x.new_rank xr, not (x.s - l.s >= 0.2 and x.e) swap from l join a2 using (task_id) join x on l.task_id = x.task_id and l.k = 3 and x.k = a2.j + a2.swap::int),
w as (select task_id, mine, mr, other, xr from a1 where swap union all select task_id, mine, mr, other, xr from a2 where swap union all select task_id, mine, mr, other, xr from a3 where swap),
moved as (select task_id, mine business_id, xr final_rank from w union all select task_id, other, mr from w)
select task_id, business_id, base_rank, new_rank, coalesce(final_rank, new_rank) final_rank from r left join moved using (task_id, business_id)""")
def top_protected_ranking(spark: SparkSession, folder: str) -> DataFrame:
    mixed = F.round(c("fusion_score") * 20 + F.conv(F.substring(S.hash_order("mix", c("task_id"), c("business_id")), 1, 8), 16, 10).cast("double") / 2**32, 9)
    fused = _fused(spark, folder, 30).withColumn("mixed", mixed).withColumn("backed", c("route_count") >= 2)
    ranked = fused.withColumn("new_rank", F.row_number().over(Window.partitionBy("task_id").orderBy(c("mixed").desc(), "business_id")))
    return R.protect_top(ranked, "task_id", "business_id", "new_rank", "rank", "mixed", evidence="backed").select("task_id", "business_id", c("rank").alias("base_rank"), "new_rank", "final_rank")


@query()
def balanced_business_selection(spark: SparkSession, folder: str) -> DataFrame:
    return R.greedy_balanced(businesses(spark, folder).where("city is not null"), "city", "business_id", "categories", 10, "rating")
