"""Queries of the training-data operators, on the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import encode_texts
from lodestone.llm.near_duplicates import NearDuplicates
from lodestone.llm.packing import pack_texts
from lodestone.llm.similar_vectors import nearest
from lodestone.llm.split_overlap import split_overlap
from lodestone.llm.stuffed_pages import stuffed_pages
from lodestone.llm.top_items import top_items
from lodestone.sources.tables import table


def _review_records(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "reviews", "review_id", "text").select(F.lit("review").alias("kind"), F.col("review_id").alias("id"), "text")
    segments = table(spark, folder, "review_segments", "segment_id", "segment_text").select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id"), F.col("segment_text").alias("text"))
    return reviews.union(segments)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = NearDuplicates(_review_records(spark, folder), threshold=0.5, shingle=3).pairs()
    return pairs.select(F.col("kind").alias("record_kind"), "id_a", "id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = NearDuplicates(_review_records(spark, folder), threshold=0.8, shingle=5, min_words=5, short_copies=True).groups()
    return groups.withColumnRenamed("kind", "record_kind").withColumnRenamed("id", "record_id")


def p4_found(spark: SparkSession, folder: str, tally: tuple = ()) -> DataFrame:
    hits = table(spark, folder, "segment_hits", "case_id", "point_id", "score").where("score is not null and not isnan(score)")
    owners = table(spark, folder, "review_segments", "point_id", "business_id").where("business_id is not null").groupBy("point_id").agg(F.min("business_id").alias("business_id"))
    return top_items(hits.join(owners, "point_id"), ["case_id", "business_id"], "point_id", "score", 5, tally).select("case_id", "business_id", "point_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(table(spark, folder, "segment_vectors", "point_id", "vector"), "point_id", "vector")
    return near.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, name, "case_id", "split", "query_text").select(F.lit(name).alias("source"), F.col("case_id").alias("id"), "split", F.col("query_text").alias("text")) for name in ("seed_queries", "long_tail_02")]
    return parts[0].union(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = split_overlap(_requests(spark, folder))
    return found.select("eval_source", "eval_split", F.least("eval_id", "train_id").alias("case_a"), F.greatest("eval_id", "train_id").alias("case_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    found = split_overlap(_requests(spark, folder))
    return found.groupBy("eval_source", "eval_split", "train_source").agg(
        F.countDistinct("eval_id").alias("n_eval_records"), F.countDistinct("train_id").alias("n_train_records"), F.count("*").alias("n_pairs"), F.round(F.max("containment"), 6).alias("max_containment")
    )


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack_texts(table(spark, folder, "documents", "doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents", "doc_id", "text", "lang"), lang_col="lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_report": p6_report, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found}


_P4 = """
with best as (
  select case_id, point_id, max(score) score from segment_hits where score is not null and not isnan(score) group by all),
owners as (select point_id, min(business_id) business_id from review_segments where business_id is not null group by 1),
ranked as (
  select case_id, business_id, point_id, row_number() over (partition by case_id, business_id order by score desc, point_id) r
  from best join owners using (point_id))
select case_id, business_id, point_id from ranked where r <= 5
"""


_P1 = r"""
with rec as (
  select distinct 'review' kind, review_id id, text from reviews where review_id is not null and text is not null
  union all
  select distinct 'segment', segment_id, segment_text from review_segments where segment_id is not null and segment_text is not null),
words as (select kind, id, md5(text) t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from rec),
runs as (select distinct kind, id, t, unnest([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)]) s from words where len(w) >= 20),
sizes as (select kind, id, t, count(*) n from runs group by all),
shared as (select a.kind, a.id id_a, a.t ta, b.id id_b, b.t tb, count(*) k from runs a join runs b on a.kind = b.kind and a.s = b.s and a.id < b.id group by all)
select distinct x.kind record_kind, id_a, id_b from shared x join sizes p on p.kind = x.kind and p.id = id_a and p.t = ta join sizes q on q.kind = x.kind and q.id = id_b and q.t = tb
where 2 * k >= p.n + q.n - k
"""


#: Full-width digits, letters and marks, which NFKC writes as ASCII; no other character of the requests has a compatibility form.
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_PAIRS = rf"""
with raw as (select 'seed_queries' src, case_id id, split, query_text q from seed_queries union all select 'long_tail_02', case_id, split, query_text from long_tail_02),
rec as (
  select distinct src, id, case when lower(trim(split)) = 'dev' then 'development' else lower(trim(split)) end split, regexp_replace(lower(translate(q, '{_WIDE}', '{_PLAIN}')), '[^\p{{L}}\p{{N}}]', '', 'g') t
  from raw where q is not null and id is not null),
sets as (select t, list_distinct([substring(t, i, 3) for i in range(1, length(t) - 1)]) g from (select distinct t from rec where length(t) >= 12 and split in ('train', 'development', 'test'))),
ev as (select distinct t, unnest(g) x from sets where t in (select t from rec where split in ('development', 'test'))),
tr as (select distinct t, unnest(g) x from sets where t in (select t from rec where split = 'train')),
k as (select ev.t a, tr.t b, count(*) k from ev join tr using (x) group by all),
near as (select a, b, k / len(p.g)::double containment, k / (len(p.g) + len(q.g) - k)::double jaccard from k join sets p on p.t = a join sets q on q.t = b where k >= 0.6::double * (len(p.g) + len(q.g) - k) - 1e-9),
pairs as (
  select distinct e.src eval_source, e.split eval_split, e.id eval_id, r.src train_source, r.id train_id, containment, jaccard
  from near join rec e on e.t = a and e.split in ('development', 'test') join rec r on r.t = b and r.split = 'train' where not (e.src = r.src and e.id = r.id))
"""
_P6 = _PAIRS + "select distinct eval_source, eval_split, least(eval_id, train_id) case_a, greatest(eval_id, train_id) case_b from pairs"
_P6_REPORT = _PAIRS + """select eval_source, eval_split, train_source, count(distinct eval_id) n_eval_records, count(distinct train_id) n_train_records, count(*) n_pairs, round(max(containment), 6) max_containment
from pairs group by all"""


_GROUPS = r"""
with recursive rec as (
  select distinct 'review' kind, review_id id, text from reviews where review_id is not null and text is not null
  union all
  select distinct 'segment', segment_id, segment_text from review_segments where segment_id is not null and segment_text is not null),
words as (select kind, id, md5(text) t, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from rec),
texts as (select kind, t, any_value(w) w, count(distinct id) n from words group by 1, 2),
runs as (select distinct kind, t, unnest([concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) for i in range(1, len(w) - 3)]) s from texts where len(w) >= 5),
sizes as (select kind, t, count(*) k from runs group by 1, 2),
half as (select a.kind, a.t a, b.t b, count(*) k from runs a join runs b on a.kind = b.kind and a.s = b.s and a.t < b.t group by all),
near as (select half.kind, a, b from half join sizes p on p.kind = half.kind and p.t = a join sizes q on q.kind = half.kind and q.t = b where half.k >= 0.8::double * (p.k + q.k - half.k) - 1e-9),
lnk as (select kind, a, b from near union all select kind, b, a from near),
reach as (select kind, t a, t b from texts union select r.kind, r.a, l.b from reach r join lnk l on l.kind = r.kind and l.a = r.b),
root as (select kind, a t, min(b) root from reach group by 1, 2),
links as (select x.kind, x.t, case when len(w) >= 1 then n - 1 else 0 end + coalesce((select sum(o.n) from lnk l join texts o on o.kind = l.kind and o.t = l.b where l.kind = x.kind and l.a = x.t), 0) k from texts x),
per as (select words.kind, words.id, case when links.k > 0 then root else words.id || words.t end root, links.k from words join root using (kind, t) join links using (kind, t)),
least_id as (select kind, root, min(id) g from per group by 1, 2)
select per.kind record_kind, per.id record_id, coalesce(min(g) filter (k > 0), per.id) group_id, max(k)::bigint n_links from per join least_id using (kind, root) group by 1, 2
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_groups": _GROUPS, "p4_found": _P4, "p6_found": _P6, "p6_report": _P6_REPORT}
