"""Texts, vectors, evidence and evaluation on the review tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import evidence as E
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import text as T
from lodestone.operators.learning import batch_score, linear, pairwise_logistic
from lodestone.operators.trees import LambdaMart
from lodestone.operators.vectors import cosine_top
from lodestone.plans.base import BIZ, INTER, TASKS, businesses, interactions, tasks
from lodestone.plans.recommend import _CATEGORY, _FUSED, _FUSED_500, _QUALITY, _QUALITY_ROUTE, _ROUTES, PER_ROUTE, _fused, _quality_route, _ranked
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


_LATIN = "regexp_extract_all(lower(text), '[a-z0-9]+')"
#: The SQL of text.unicode_words.
_WORDS = r"""list_concat(regexp_extract_all(regexp_replace(lower(text), '[\x{3400}-\x{9fff}]+', ' ', 'g'), '[\p{L}\p{M}\p{N}]+(?:''[\p{L}\p{M}\p{N}]+)?'),
 flatten([[substring(r, i, 2) for i in range(1, greatest(2, len(r)))] for r in regexp_extract_all(lower(text), '[\x{3400}-\x{9fff}]+')]))"""
_TERMS = ("parking", "terrace", "lamb", "noodles", "kids")
_F = ", ".join(f"len([x for x in w if x = '{t}'])::double f{i}" for i, t in enumerate(_TERMS))
_DF = ", ".join(f"count(*) filter (f{i} > 0) df{i}" for i in range(len(_TERMS)))
_S = " + ".join(f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * f{i} * 2.5::double / (f{i} + 1.5::double * (0.25::double + 0.75::double * len / mean))" for i in range(len(_TERMS)))


@query(f"""with t as (select business_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents where text is not null and business_id is not null),
k as (select business_id, doc_id, len(w)::double len, {_F} from t), st as (select business_id, count(*) n, greatest(avg(len), 1e-9) mean, {_DF} from k group by 1),
sc as (select k.business_id, doc_id, round({_S}, 9) score from k join st using (business_id)),
r as (select *, row_number() over (partition by business_id order by score desc, doc_id) rank from sc where score > 0)
select business_id, doc_id, score, rank from r where rank <= 5""")
def bm25_top_per_business(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25_top(spark, folder, T.latin_words)


@query(SQL["bm25_top_per_business"].replace(_LATIN, _WORDS))
def bm25_top_per_business_unicode(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25_top(spark, folder, T.unicode_words)


def _bm25_top(spark: SparkSession, folder: str, words: Callable[[Column], Column]) -> DataFrame:
    scored = T.bm25(table(spark, folder, "documents", "business_id", "doc_id", "text"), "business_id", "doc_id", "text", _TERMS, words=words)
    return R.route_top(scored, "business_id", "doc_id", "score", 5, keep_zero=False).select("business_id", "doc_id", "score", "rank")


_TFIDF = """tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from documents where text is not null),
tf as (select doc_id, term, count(*) f from tok group by 1, 2), nn as (select count(*) n from documents where text is not null),
dfs as (select term, count(*) df from tf group by 1 having count(*) >= 2),
raw as (select doc_id, term, (1 + ln(f)) * (ln((1 + n) / (1 + df)::double) + 1) w from tf join dfs using (term), nn),
unit as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) weight from raw)"""


@query(f"""with {_TFIDF}, b as (select doc_id, business_id from documents where business_id is not null), cen as (select business_id, term, sum(weight) cw from unit join b using (doc_id) group by 1, 2),
nrm as (select business_id, sqrt(sum(cw * cw)) nrm from cen group by 1)
select u.doc_id, round(sum(u.weight * cw) / any_value(nrm), 6) cosine from unit u join b using (doc_id) join cen on cen.business_id = b.business_id and cen.term = u.term join nrm on nrm.business_id = b.business_id group by 1""")
def tfidf_cosine_to_business(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf_cosine(spark, folder, T.latin_words)


@query(SQL["tfidf_cosine_to_business"].replace(_LATIN, _WORDS))
def tfidf_cosine_to_business_unicode(spark: SparkSession, folder: str) -> DataFrame:
    return _tfidf_cosine(spark, folder, T.unicode_words)


def _tfidf_cosine(spark: SparkSession, folder: str, words: Callable[[Column], Column]) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "business_id")
    unit = T.tfidf(docs, "doc_id", "text", words=words)
    placed = unit.join(docs.where("business_id is not null").select("doc_id", "business_id"), "doc_id")
    centre = placed.groupBy("business_id", "term").agg(F.sum("weight").alias("cw"))
    norm = centre.groupBy("business_id").agg(F.sqrt(F.sum(c("cw") * c("cw"))).alias("norm"))
    return placed.join(centre, ["business_id", "term"]).groupBy("doc_id", "business_id").agg(F.sum(c("weight") * c("cw")).alias("s")).join(norm, "business_id").select("doc_id", F.round(c("s") / c("norm"), 6).alias("cosine"))


@query(f"with {_TFIDF} select doc_id, term, rank from (select doc_id, term, row_number() over (partition by doc_id order by round(weight, 9) desc, term) rank from unit) where rank <= 5")
def top_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return T.top_terms(T.tfidf(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id", 5).select("doc_id", "term", "rank")


@query(SQL["top_keywords"].replace(_LATIN, _WORDS))
def top_keywords_unicode(spark: SparkSession, folder: str) -> DataFrame:
    return T.top_terms(T.tfidf(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", words=T.unicode_words), "doc_id", 5).select("doc_id", "term", "rank")


def _passages_sql(overlap: bool) -> str:
    """For texts whose sentences all fit a passage, which those of the tables do; longer ones are tested against brute force."""
    blank = [x for x in map(chr, range(0x10000)) if x.isspace()]
    space, trimmed = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in blank) + "]", "'" + "".join(blank) + "'"
    closing = f"[.!?]{space}+|[。！？]" if overlap else f"[.!?。！？]{space}+"
    back = "coalesce(list_max([x for x in ends if x < e and x > s]), e)" if overlap else "e"
    truncated = "" if overlap else ", n > 8 truncated"
    return rf"""with recursive rev as (select review_id, min(text) t from reviews where text is not null group by 1 having min(text) is not null),
sen as (select review_id, t, [x for x in regexp_extract_all(t, '(?s).*?(?:{closing}|\n+|$)') if x <> ''] parts from rev where t <> ''),
en as (select review_id, t, [list_sum([length(y) for y in parts[1:i]])::bigint for i in range(1, len(parts) + 1)] ends from sen),
p as (select review_id, t, ends, 0::bigint k, 0::bigint s, list_max([x for x in ends if x <= 900]) e from en
 union all select review_id, t, ends, k + 1, {back}, list_max([x for x in ends if x <= {back} + 900]) from p where e < length(t)),
c as (select review_id, k, s + length(part) - length(ltrim(part, {trimmed})) s2, e - (length(part) - length(rtrim(part, {trimmed}))) e2, trim(part, {trimmed}) part, count(*) over (partition by review_id) n from (select *, substring(t, (s + 1)::int, (e - s)::int) part from p) where trim(part, {trimmed}) <> ''),
q as (select *, row_number() over (partition by review_id order by k) - 1 i from c)
select review_id, i::int segment_index, s2::int char_start, e2::int char_end, sha256(review_id || chr(31) || i || chr(31) || s2 || chr(31) || e2 || chr(31) || sha256(part)) segment_id{truncated} from q
where {'true' if overlap else 'i < 8 and (i = 0 or e2 - s2 >= 20)'}""".replace("\\\\", "\\")


@query(_passages_sql(False))
def review_passages(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "reviews", "review_id", "text").where("text is not null").groupBy("review_id").agg(F.min("text").alias("text"))
    return T.segments(reviews, "review_id", "text").drop("segment_text")


@query(_passages_sql(True))
def review_passages_overlapping(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "reviews", "review_id", "text").where("text is not null").groupBy("review_id").agg(F.min("text").alias("text"))
    return T.segments(reviews, "review_id", "text", overlap=True).drop("segment_text")


LEXICON = {
    "service": (("attentive", "helpful", "charming", "cheerful", "gracious"), ("curt", "rude", "aloof", "slow", "distracted")),
    "quiet_environment": (("calm", "hushed", "quiet", "airy"), ("loud", "deafening", "chaotic", "buzzing", "echoing")),
    "food_quality": (("gorgeous", "tender", "superb", "fragrant", "delicate"), ("stale", "greasy", "undercooked", "rubbery", "soggy", "oversalted")),
}


@query()
def review_aspects(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "reviews", "review_id", "text").where("text is not null").groupBy("review_id").agg(F.min("text").alias("text"))
    return T.extract_aspects(reviews, "review_id", "text", LEXICON)


@query("""select segment_id, round(2.0::double * contains(lower(segment_text), 'parking took')::int + (contains(lower(segment_text), 'pa')::int + contains(lower(segment_text), 'ar')::int + contains(lower(segment_text), 'rk')::int + contains(lower(segment_text), 'ki')::int + contains(lower(segment_text), 'in')::int
 + contains(lower(segment_text), 'ng')::int + contains(lower(segment_text), 'g ')::int + contains(lower(segment_text), ' t')::int + contains(lower(segment_text), 'to')::int + contains(lower(segment_text), 'oo')::int + contains(lower(segment_text), 'ok')::int) / 11.0::double, 9) overlap from review_segments""")
def character_pair_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review_segments", "segment_id", "segment_text").select("segment_id", F.round(T.char_pair_overlap(c("segment_text"), "parking took"), 9).alias("overlap"))


@query("""with q as (select vec_id, embedding::double[] v from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, e.vec_id id, round(list_dot_product(q.v, e.embedding::double[]) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 6) cosine from q join embeddings e on e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by cosine desc, id) rank from s) select query_id, id, cosine from r where rank <= 10""")
def embedding_top(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    return cosine_top(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, 64).select("query_id", "id", F.round("cosine", 6).alias("cosine"))


@query("""with a as (select label, min_by(embedding, vec_id)::double[] v from embeddings group by 1), s as (select e.vec_id, a.label anchor, round(list_dot_product(e.embedding::double[], a.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 6) cosine from embeddings e, a)
select vec_id, min(anchor) filter (cosine = best) best_anchor, max(best) best from (select *, max(cosine) over (partition by vec_id) best from s) group by 1""")
def anchor_max(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))  # one row a label
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(anchors)).select("vec_id", "label", F.round(S.cosine(c("embedding"), c("v")), 6).alias("cosine"))
    best = s.groupBy("vec_id").agg(F.max(F.struct(c("cosine"), (-c("label")).alias("neg"))).alias("x"))
    return best.select("vec_id", (-c("x.neg")).alias("best_anchor"), c("x.cosine").alias("best"))


# evidence

_END = "timestamp '2025-01-01'"
_SENTIMENT = "case when stars >= 4 then 'positive' when stars <= 2 then 'negative' else 'neutral' end"
_ASPECT = "case when regexp_matches(lower(text), 'waiter|server|counterperson|barista') then 'service' when regexp_matches(lower(text), 'parking') then 'parking' else 'other' end"
_MENTIONS = f"""men as (select review_id, min(business_id) business_id, min(user_id) user_id, min(stars) stars, min(review_time) event_time, min(text) text from reviews
 where business_id is not null and user_id is not null and stars is not null and review_time is not null and text is not null group by 1),
m as (select *, {_SENTIMENT} sentiment, {_ASPECT} aspect, 0.5::double + 0.1::double * stars confidence, pow(0.5, (epoch_us({_END}) - epoch_us(event_time)) / 86400000000.0::double / 365) decay from men where event_time < {_END})"""


def _mentions(spark: SparkSession, folder: str, cutoff: str = "2025-01-01") -> DataFrame:
    """What reviews before the ``cutoff`` say, as seen at that time."""
    r = table(spark, folder, "reviews", "review_id", "business_id", "user_id", "stars", "review_time", "text").dropna()
    r = r.groupBy("review_id").agg(*(F.min(n).alias(n) for n in ("business_id", "user_id", "stars")), F.min("review_time").alias("event_time"), F.min("text").alias("text"))
    low = F.lower("text")
    aspect = F.when(low.rlike("waiter|server|counterperson|barista"), "service").when(low.rlike("parking"), "parking").otherwise("other")
    sentiment = F.when(c("stars") >= 4, "positive").when(c("stars") <= 2, "negative").otherwise("neutral")
    end = F.lit(cutoff).cast("timestamp_ntz")
    return r.where(c("event_time") < end).withColumns({"sentiment": sentiment, "aspect": aspect, "confidence": 0.5 + 0.1 * c("stars"), "cutoff_time": end})


@query(f"""with {_MENTIONS}, g as (select user_id, aspect, sum((stars - 3) / 2 * decay * confidence) / sum(decay * confidence) s, sum(decay * confidence) mass, count(*) evidence_count, min(event_time) first_seen, max(event_time) last_confirmed from m group by 1, 2)
select user_id, aspect, round(greatest(-1.0, least(1.0, s)), 9) score, round((1 - exp(-mass / 3)) * (0.5 + 0.5 * abs(s)), 9) confidence, evidence_count, round(mass, 9) effective_evidence, first_seen, last_confirmed from g""")
def decayed_preference_signal(spark: SparkSession, folder: str) -> DataFrame:
    return E.decayed_signal(_mentions(spark, folder).withColumn("direction", (c("stars") - 3) / 2), ["user_id", "aspect"])


@query(f"""with {_MENTIONS}, g as (select business_id, aspect, count(*) filter (sentiment = 'positive') positive_count, count(*) filter (sentiment = 'negative') negative_count, count(*) filter (sentiment = 'neutral') neutral_count, count(*) filter (sentiment = 'mixed') mixed_count,
 count(*) evidence_count, count(distinct user_id) unique_users, count(distinct user_id) filter (sentiment <> 'neutral') du, coalesce(sum(decay * confidence) filter (sentiment = 'positive'), 0) wp, coalesce(sum(decay * confidence) filter (sentiment = 'negative'), 0) wn, sum(decay * confidence) mass, max(event_time) latest from m group by 1, 2),
k as (select *, positive_count + negative_count >= 3 and du >= 2 and wp + wn > 0 known from g)
select business_id, aspect, case when known then 'known' else 'unknown' end as status, positive_count, negative_count, neutral_count, mixed_count, evidence_count, unique_users, round(mass, 9) effective_evidence,
 round(case when known then wp / (wp + wn) end, 9) weighted_positive_ratio, round(case when known then wn / (wp + wn) end, 9) weighted_negative_ratio,
 round(case when known then (1 - exp(-(wp + wn) / 3)) * (0.5 + 0.25 * (1 - exp(-du / 3.0::double)) + 0.25 * greatest(wp, wn) / (wp + wn)) else 0 end, 9) confidence, coalesce(known and wp / nullif(wp + wn, 0) >= 0.35 and wn / nullif(wp + wn, 0) >= 0.35, false) as conflict, latest from k""")
def aspect_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.aspect_summary(_mentions(spark, folder), ["business_id", "aspect"])


@query(f"""with {_MENTIONS}, w as (select *, round((0.3::double + 0.1::double * stars) * pow(0.5, (epoch_us({_END}) - epoch_us(event_time)) / 86400000000.0::double / 730), 9) w from m where sentiment <> 'neutral'),
t as (select *, row_number() over (partition by business_id, sentiment order by w desc, review_id) r from w), s as (select business_id, sentiment, avg(w) a, count(*) k from t where r <= 5 group by 1, 2)
select business_id, sum(k) filter (sentiment = 'positive') is null no_positive, round(greatest(0.0, least(1.0, 0.5 + 0.5 * coalesce(max(a * ln(1 + k) / ln(6.0::double)) filter (sentiment = 'positive'), 0) - 0.5 * coalesce(max(a * ln(1 + k) / ln(6.0::double)) filter (sentiment = 'negative'), 0))), 9) evidence_score from s group by 1""")
def evidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _mentions(spark, folder).select("business_id", c("review_id").alias("evidence_id"), c("sentiment").alias("direction"), (0.3 + 0.1 * c("stars")).alias("similarity"), "event_time", "cutoff_time")
    return E.evidence_score(rows, ["business_id"]).select("business_id", (c("n_positive") == 0).alias("no_positive"), "evidence_score")


@query(f"""with {_MENTIONS}, p as (select business_id, aspect, review_id, user_id, case sentiment when 'positive' then 'supports' when 'negative' then 'contradicts' else 'neutral' end stance, round(decay * confidence, 9) weight, confidence relevance, decay recency from m),
r as (select *, row_number() over (partition by business_id, aspect order by stance = 'neutral', weight desc, review_id) r from p),
g as (select business_id, aspect, count(*) evidence_count, count(distinct user_id) users, count(*) filter (stance = 'supports') support_count, count(*) filter (stance = 'contradicts') contradiction_count, coalesce(sum(weight) filter (stance = 'supports'), 0) sm, coalesce(sum(weight) filter (stance = 'contradicts'), 0) cm,
 avg(relevance) rel, avg(recency) rec, coalesce(string_agg(review_id, ',' order by r) filter (r <= 3 and stance <> 'neutral'), '') citations from r group by 1, 2),
k as (select *, support_count >= 2 and contradiction_count >= 2 and least(sm, cm) / nullif(sm + cm, 0) >= 0.3 hc from g)
select business_id, aspect, evidence_count, support_count, contradiction_count, round(sm, 9) support_mass, round(cm, 9) contradiction_mass,
 case when sm + cm <= 0 then 'insufficient' when hc then 'mixed' when sm / (sm + cm) >= 0.6 then 'supports' when cm / (sm + cm) >= 0.6 then 'contradicts' else 'mixed' end consensus, coalesce(hc, false) has_conflict,
 round(rel * rec * coalesce(greatest(sm, cm) / nullif(sm + cm, 0), 0) * least(1.0, users / 3.0::double) * evidence_count / (evidence_count + 3.0::double), 9) confidence, citations from k""")
def evidence_consensus(spark: SparkSession, folder: str) -> DataFrame:
    stance = F.when(c("sentiment") == "positive", "supports").when(c("sentiment") == "negative", "contradicts").otherwise("neutral")
    decay = S.half_life_weight(S.age_days(c("event_time"), c("cutoff_time")), 365.0)
    rows = _mentions(spark, folder).select("business_id", "aspect", c("review_id").alias("evidence_id"), "user_id", stance.alias("stance"), F.round(decay * c("confidence"), 9).alias("weight"), c("confidence").alias("relevance"), decay.alias("recency"))
    return E.consensus(rows, ["business_id", "aspect"])


@query("""with h as (select case_id, point_id, max(score) score, min(dense_rank) dr from segment_hits where score is not null and not isnan(score) group by all), own as (select point_id, min(business_id) business_id, max(useful) useful from review_segments where business_id is not null group by 1),
a as (select case_id, business_id, point_id, row_number() over (partition by case_id, business_id order by score desc, point_id) rd, row_number() over (partition by case_id, business_id order by coalesce(useful, 0) desc, point_id) ru from h join own using (point_id)),
f as (select case_id, business_id, point_id, round(1.0::double / (60 + rd) + 0.5::double / (60 + ru), 9) fused from a)
select case_id, business_id, point_id, fused from (select *, row_number() over (partition by case_id, business_id order by fused desc, point_id) r from f) where r <= 3""")
def grouped_hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)").groupBy("case_id", "point_id").agg(F.max("score").alias("score"))
    own = table(spark, folder, "review_segments", "point_id", "business_id", "useful").where("business_id is not null").groupBy("point_id").agg(F.min("business_id").alias("business_id"), F.max("useful").alias("useful"))
    w = Window.partitionBy("case_id", "business_id")
    both = h.join(own, "point_id").withColumn("rd", F.row_number().over(w.orderBy(c("score").desc(), "point_id"))).withColumn("ru", F.row_number().over(w.orderBy(F.coalesce("useful", F.lit(0)).desc(), "point_id")))
    fused = both.withColumn("fused", F.round(1.0 / (60 + c("rd")) + 0.5 / (60 + c("ru")), 9))
    return fused.withColumn("r", F.row_number().over(w.orderBy(c("fused").desc(), "point_id"))).where("r <= 3").select("case_id", "business_id", "point_id", "fused")


# evaluation

_TARGET = "v as (select k.task_id, k.user_id, k.split, k.history_count, i.business_id target from tasks k join inter i on i.user_id = k.user_id and i.t = k.cutoff_time)"
_RANKS = f"{_ROUTES}, {_FUSED}, {_TARGET}, tr as (select v.*, f.rank target_rank from v left join (select * from fused where rank <= 500) f on f.task_id = v.task_id and f.business_id = v.target)"
_RANKS_500 = _RANKS.replace(_FUSED, _FUSED_500)
_HR = """round(avg(case when target_rank <= 1 then 1.0 else 0.0 end), 9) hr_1, round(avg(case when target_rank <= 3 then 1.0 else 0.0 end), 9) hr_3, round(avg(case when target_rank <= 5 then 1.0 else 0.0 end), 9) hr_5,
 round(avg(coalesce(1.0::double / target_rank, 0)), 9) mrr, round(avg(case when target_rank <= 5 then 1 / log2(target_rank + 1) else 0 end), 9) ndcg_5"""


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return tasks(spark, folder).join(interactions(spark, folder).withColumnRenamed("t", "cutoff_time"), ["user_id", "cutoff_time"]).select("task_id", "user_id", "split", "history_count", c("business_id").alias("target"))


def _ranks(spark: SparkSession, folder: str, per_route: int = PER_ROUTE) -> DataFrame:
    wanted = _wanted(spark, folder)
    return M.target_ranks(_targets(spark, folder), _fused(spark, folder, 500, per_route, shown=(), wanted=wanted), "task_id", "business_id")


def _wanted(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select("task_id", c("target").alias("business_id"))


def _both_ranks(spark: SparkSession, folder: str, per_route: int = PER_ROUTE) -> DataFrame:
    """Tasks with their target's rank in the fused list and, as qr, in the quality route; one walk, and of each task's lists only the target becomes a row."""
    placed = _fused(spark, folder, 500, per_route, shown=(), also={"quality": 500}, wanted=_wanted(spark, folder))
    placed = placed.select("task_id", c("business_id").alias("target"), c("rank").cast("bigint").alias("target_rank"), c("quality_rank").cast("bigint").alias("qr"))
    ranks = _targets(spark, folder).join(placed, ["task_id", "target"], "left")
    # a task with more than one target meets each rank of one list with each of the other
    per = ranks.groupBy("task_id").agg(F.collect_list(F.struct("user_id", "history_count", "target_rank")).alias("x"), F.collect_list(F.struct("qr")).alias("y"))
    return per.select("task_id", F.explode("x").alias("x"), "y").select("task_id", "x.*", F.explode("y").alias("y")).select("task_id", "user_id", "history_count", "target_rank", "y.qr")


@query(f"with {_RANKS} select split, count(*) n, {_HR}, round(avg(case when target_rank <= 100 then 1.0 else 0.0 end), 9) recall_100 from tr group by 1")
def hr_mrr_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    return _hr_by_split(_ranks(spark, folder, 50))


@query(SQL["hr_mrr_ndcg"].replace(_RANKS, _RANKS_500))
def hr_mrr_ndcg_500(spark: SparkSession, folder: str) -> DataFrame:
    return _hr_by_split(_ranks(spark, folder))


def _hr_by_split(ranks: DataFrame) -> DataFrame:
    aggregates = M.single_positive(c("target_rank")) | {"recall_100": F.round(F.avg(F.when(c("target_rank") <= 100, 1.0).otherwise(0.0)), 9)}
    return ranks.groupBy("split").agg(F.count("*").alias("n"), *(a.alias(n) for n, a in aggregates.items()))


@query(f"with {_RANKS} select case when history_count < 3 then 'short' when history_count < 8 then 'middle' else 'long' end bucket, count(*) n, count(target_rank) n_retrieved, {_HR} from tr group by 1")
def segment_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _hr_by_history(_ranks(spark, folder, 50))


@query(SQL["segment_metrics"].replace(_RANKS, _RANKS_500))
def segment_metrics_500(spark: SparkSession, folder: str) -> DataFrame:
    return _hr_by_history(_ranks(spark, folder))


def _hr_by_history(ranks: DataFrame) -> DataFrame:
    bucket = F.when(c("history_count") < 3, "short").when(c("history_count") < 8, "middle").otherwise("long")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count("target_rank").alias("n_retrieved"), *(a.alias(n) for n, a in M.single_positive(c("target_rank")).items()))


@query(f"""with {_RANKS}, q2 as (select v.task_id, q.rank qr from v left join (select * from qroute where rank <= 500) q on q.task_id = v.task_id and q.business_id = v.target)
select case when target_rank < coalesce(qr, 501) then 'improved' when coalesce(target_rank, 501) > coalesce(qr, 501) then 'worsened' else 'unchanged' end movement, count(*) n from tr join q2 using (task_id) group by 1""")
def rank_movement(spark: SparkSession, folder: str) -> DataFrame:
    return _movement(_both_ranks(spark, folder, 50))


@query(SQL["rank_movement"].replace(_RANKS, _RANKS_500))
def rank_movement_500(spark: SparkSession, folder: str) -> DataFrame:
    return _movement(_both_ranks(spark, folder))


def _movement(both: DataFrame) -> DataFrame:
    a, b = F.coalesce("target_rank", F.lit(501)), F.coalesce("qr", F.lit(501))
    return both.groupBy(F.when(a < b, "improved").when(a > b, "worsened").otherwise("unchanged").alias("movement")).agg(F.count("*").alias("n"))


_GRID = ", ".join(f"({q / 4}::double, {x / 4}::double)" for q in range(5) for x in range(5 - q))


@query(f"""with {_QUALITY}, {_QUALITY_ROUTE}, {_CATEGORY}, {_TARGET}, cand as (select q.task_id, q.business_id, q.score q, coalesce(x.score, 0) x, 1 - (q.rank - 1) / 100.0::double z from qroute q left join croute x using (task_id, business_id) where q.rank <= 100),
grid(wq, wx) as (values {_GRID}), r as (select wq, wx, cand.task_id, business_id, row_number() over (partition by wq, wx, cand.task_id order by round(wq * q + wx * x + (1 - wq - wx) * z, 9) desc, business_id) rank from cand, grid)
select wq, wx, count(*) n, round(avg(coalesce(1.0::double / rank, 0)), 9) mrr from (select wq, wx, v.task_id, max(rank) filter (r.business_id = v.target) rank from r join v using (task_id) group by 1, 2, 3) group by 1, 2""")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    cand = _ranked(spark, folder, "quality", 100).select("task_id", "business_id", c("score").alias("q"), F.coalesce("category", F.lit(0.0)).alias("x"), (1 - (c("rank") - 1) / 100.0).alias("z"))
    grid = spark.createDataFrame([(w["q"], w["x"]) for w in R.simplex(0.25, ["q", "x", "z"])], "wq double, wx double")
    score = F.round(c("wq") * c("q") + c("wx") * c("x") + (1 - c("wq") - c("wx")) * c("z"), 9)
    ranked = cand.crossJoin(F.broadcast(grid)).withColumn("rank", F.row_number().over(Window.partitionBy("wq", "wx", "task_id").orderBy(score.desc(), "business_id")))
    hit = ranked.join(_targets(spark, folder).select("task_id", "target"), "task_id").groupBy("wq", "wx", "task_id").agg(F.max(F.when(c("business_id") == c("target"), c("rank"))).alias("rank"))
    return hit.groupBy("wq", "wx").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / c("rank"), F.lit(0.0))), 9).alias("mrr"))


@query(f"""with {_MENTIONS}, x as (select review_id, round(1 / (1 + exp(-(len(text) - 400) / 300.0::double)), 6) p, (stars >= 4)::int o from m), r as (select *, row_number() over (order by p, review_id) - 1 i, count(*) over () n from x),
b as (select *, case when i < (n % 10) * (n // 10 + 1) then i // (n // 10 + 1) else n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) end bin from r), g as (select bin, count(*) k, avg(p) p, avg(o) o, sum(pow(p - o, 2)) se from b group by 1)
select sum(k)::bigint n, round(sum(se) / sum(k), 9) brier, round(sum(k * abs(p - o)) / sum(k), 9) ece from g""")
def calibration_brier_ece(spark: SparkSession, folder: str) -> DataFrame:
    x = _mentions(spark, folder).select("review_id", F.round(1 / (1 + F.exp(-(F.length("text") - 400) / 300.0)), 6).alias("p"), (c("stars") >= 4).cast("int").alias("o"))
    return M.calibration(x, "p", "o", ["review_id"])


@query("""with l as (select doc_id, min(page_label) filter (annotator is not null) truth, max(page_label) predicted from page_labels group by 1), k as (select truth, predicted, count(*) n from l where truth is not null group by 1, 2),
lab as (select truth label from k union select predicted from k), s as (select label, coalesce(sum(n) filter (truth = label), 0) support, coalesce(sum(n) filter (predicted = label), 0) said, coalesce(sum(n) filter (truth = label and predicted = label), 0) hit from lab, k group by 1)
select label, support::bigint support, round(case when said = 0 then 0 else hit / said::double end, 9) as precision, round(case when support = 0 then 0 else hit / support::double end, 9) recall, round(case when support + said = 0 then 0 else 2 * hit / (support + said)::double end, 9) f1 from s""")
def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "page_labels", "doc_id", "page_label", "annotator").groupBy("doc_id").agg(F.min(F.when(c("annotator").isNotNull(), c("page_label"))).alias("truth"), F.max("page_label").alias("predicted"))
    return M.per_class(labels.where("truth is not null"), "truth", "predicted")


_TIMES = f"len([t for t in {list(M.POISSON)} if u >= t])"


@query(f"""with {_RANKS_500}, q2 as (select v.task_id, q.rank qr from v left join (select * from qroute where rank <= 500) q on q.task_id = v.task_id and q.business_id = v.target),
per as (select user_id, sum(coalesce(1.0::double / target_rank, 0) - coalesce(1.0::double / qr, 0)) d, count(*) n, ('0x' || substr(sha256('boot:' || user_id), 1, 8))::bigint % 2147483647 h from tr join q2 using (task_id) group by user_id),
z as (select b, d, n, (h + b * 2654435761 % 2147483647) % 2147483647 z from per, (select range b from range(500))), k as (select b, d, n, {_TIMES} k from (select b, d, n, (z * z % 2147483647 * z % 2147483647) / 2147483647::double u from z)),
s as (select b, sum(k * d) / nullif(sum(k * n), 0) delta from k group by 1)
select round(quantile_cont(delta, 0.025), 9) low, round(quantile_cont(delta, 0.975), 9) high, round(avg((delta > 0)::int), 9) share_above_zero, (select round(sum(d) / sum(n), 9) from per) delta from s""")
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    both = _both_ranks(spark, folder)
    rr = lambda n: F.coalesce(1 / c(n), F.lit(0.0))
    return M.paired_bootstrap(both.withColumn("left", rr("target_rank")).withColumn("right", rr("qr")), "user_id", "left", "right")


@query()
def pairwise_logistic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on differences of target and other candidates, then applied by the batch scorer."""
    cand = _ranked(spark, folder, "quality", 50).select("task_id", "business_id", c("score").alias("quality"), (1 / (60.0 + c("rank"))).alias("rr"), F.coalesce("category", F.lit(0.0)).alias("category"))
    names = ["quality", "rr", "category"]
    target = _targets(spark, folder).select("task_id", c("target").alias("business_id"))
    positive = cand.join(target, ["task_id", "business_id"]).select("task_id", *(c(n).alias(f"p_{n}") for n in names))
    pairs = cand.join(target, ["task_id", "business_id"], "left_anti").join(positive, "task_id").select(*((c(f"p_{n}") - c(n)).alias(n) for n in names))
    weights = pairwise_logistic(pairs, names)
    return batch_score(cand, ["task_id", "business_id"], names, linear(weights))


@query()
def lambdamart_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees fitted on the tasks that are not of the test split and applied to all by the batch scorer."""
    names = ["fusion_score", "quality", "category", "location"]
    cand = _fused(spark, folder, 50).select("task_id", "business_id", *names)
    target = _targets(spark, folder).where("split <> 'test'").select("task_id", "target")
    labelled = cand.join(target, "task_id").withColumn("label", (c("business_id") == c("target")).cast("int"))
    model = LambdaMart(names, rounds=4, depth=2).fit(labelled, "task_id", "label")
    scored = batch_score(cand, ["task_id", "business_id"], names, model.scorer())
    return R.route_top(scored, "task_id", "business_id", "score", 50)
