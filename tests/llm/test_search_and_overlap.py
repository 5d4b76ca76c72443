import math
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestone.llm.similar_vectors as sv
import lodestone.llm.split_overlap as so
import lodestone.llm.top_items as ti
from lodestone.llm import queries as llm
from lodestone.llm.split_overlap import split_overlap
from lodestone.llm.stuffed_pages import function_words, measure, stuffed_pages
from lodestone.llm.top_items import cluster, read_top, top_items


def best(rows, n):
    groups = {}
    for g, h, i, s in rows:
        if s is not None and s == s and i is not None:
            own = groups.setdefault((g, h), {})
            own[i] = max(own.get(i, -math.inf), s)
    return {(g, h, i, k + 1) for (g, h), own in groups.items() for k, (i, _) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n])}


def test_top_items_with_ties_repeats_nulls_and_a_hot_group(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None, "a1:"]), rnd.choice(["x", None]), rnd.choice([None, *range(900)]), rnd.choice([None, float("nan"), float("inf"), 0.5, 0.5, -0.0, 0.0, rnd.random()])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, h string, item bigint, score double").withColumn("grp", F.lit("clash")).withColumn("rank", F.lit(9))
    got = top_items(df, ["g", "h"], "item", "score", 5)
    assert {(r.g, r.h, r.item, r["rank"]) for r in got.collect()} == best(rows, 5)
    assert top_items(df.limit(0), ["g", "h"], "item", "score", 5).count() == 0


def counters(spark):
    return spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


def test_row_groups_below_the_nth_score_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(ti, "ROW_GROUP_ROWS", 512)
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.col("id").alias("item"), F.rand(1).alias("score"))
    notes = cluster(df, ["g"], "item", "score")
    assert notes.agg(F.sum("n_rows")).first()[0] == 60_000
    read = read_top(notes, "grp string, item bigint, score double, g0 string", 5).where("grp like '%hot%'").count()
    files = notes.select("file").distinct().count()
    assert notes.count() > files and read <= 5 * files
    skipped = counters(spark)
    got = top_items(df, ["g"], "item", "score", 5, skipped)
    expected = [r.item for r in df.where("g = 'hot'").orderBy(F.desc("score"), "item").limit(5).collect()]
    assert [r.item for r in got.where("g = 'hot'").orderBy("rank").collect()] == expected
    assert got.count() == 20_000 + 5


def test_row_groups_of_many_groups_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(ti, "ROW_GROUP_ROWS", 256)
    df = spark.range(40_000).select((F.col("id") % 300).cast("string").alias("g"), F.col("id").alias("item"), F.round(F.rand(2), 3).alias("score"))
    skipped = counters(spark)
    rows = [(r.g, None, r.item, r.score) for r in df.collect()]
    got = {(r.g, None, r.item, r["rank"]) for r in top_items(df, ["g"], "item", "score", 5, skipped).collect()}
    assert got == best(rows, 5) and skipped[0].value > 20


def test_p4_found_skips_row_groups(spark):
    skipped = counters(spark)
    assert llm.p4_found(spark, "/root/testdata/sf0.1", skipped).count() > 0
    assert skipped[0].value > 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "point_id bigint, vector array<float>, id string, cells int")


def exact(points, k):
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -9)
    return {(int(i), int(ids[j])) for row, i in enumerate(ids) for j in np.lexsort((ids, -s[row]))[:k]}


@pytest.mark.parametrize("part_rows", [6144, 60])
def test_nearest_reaches_nine_tenths_of_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(sv, "LIST_ROWS", 150)
    monkeypatch.setattr(sv, "MAX_PART_ROWS", part_rows)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 64))
    points = {i: (centres[i % 25] + 0.35 * rng.normal(size=64)) * rng.uniform(0.1, 9) for i in range(900)}
    rows = [(i, [float(v) for v in p], "x", 1) for i, p in points.items()]
    rows += rows[:30] + [(5000, None, "x", 1), (5001, [0.0] * 64, "x", 1), (5002, [1.0] * 63, "x", 1), (5003, [float("nan")] * 64, "x", 1), (5004, [None] + [1.0] * 63, "x", 1), (None, [1.0] * 64, "x", 1), (5005, [float("inf")] * 64, "x", 1)]
    got = sv.nearest(vectors(spark, rows), "point_id", "vector").collect()
    found, true = {(r.id, r.neighbour) for r in got}, exact(points, 5)
    assert len(found & true) / len(true) >= 0.9
    assert len(got) == len(true) and {r.id for r in got} == set(points)
    per = {}
    for r in got:
        per.setdefault(r.id, []).append((r["rank"], -r.cosine))
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] and [x[1] for x in sorted(v)] == sorted(x[1] for x in v) for v in per.values())


def test_collisions_are_those_of_the_windows_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    base = sv.unit(np.repeat(centres, 20, axis=0) + 0.3 * rng.normal(size=(800, 64)))
    arrays = sv.SortedArrays(base)
    counts = arrays.collisions(base[:9] @ arrays.axes, 0.05)
    assert (counts == (np.abs(base[:9] @ arrays.axes - (base @ arrays.axes)[:, None, :]) <= 0.05).sum(axis=2).T).all()
    q, c, cosine, verified = sv.search_list(base, base[:200], np.arange(200), 5)
    true = exact({i: row for i, row in enumerate(base)}, 5)
    found = set(zip(q.tolist(), c.tolist()))
    assert len(found & true) / sum(i < 200 for i, _ in true) > 0.98 and verified < 0.2 * 200 * 800
    lonely = sv.search_list(sv.unit(rng.normal(size=(300, 64))), base[:3], np.full(3, -1), 5)  # nothing is near: the whole list is compared
    assert len(set(lonely[0])) == 3 and len(lonely[0]) == 15 and sv.search_list(base[:1], base[:1], np.zeros(1, int), 5)[3] == 0


@pytest.mark.parametrize("hot", [64, 8])
def test_copies_of_one_vector_take_their_least_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(sv, "HOT_COPIES", hot)
    rng = np.random.default_rng(4)
    one = [float(v) for v in rng.normal(size=64)]
    rows = [(i, one, "x", 1) for i in range(40)] + [(100 + i, [float(v) for v in rng.normal(size=64)], "x", 1) for i in range(12)]
    got = {}
    for r in sv.nearest(vectors(spark, rows), "point_id", "vector").collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert all([n for _, n in sorted(got[i])] == [j for j in range(7) if j != i][:5] for i in range(40))
    assert all(len(got[100 + i]) == 5 for i in range(12))
    few = sv.nearest(vectors(spark, rows[:1] + rows[-2:]), "point_id", "vector").collect()
    assert len(few) == 6 and sv.nearest(vectors(spark, []), "point_id", "vector").count() == 0


def request_rows(seed):
    rnd = random.Random(seed)
    words = ["lamb", "tofu", "terrace", "quiet", "near", "Gate", "kids", "parking", "汤面", "安静", "停车"] + [f"name{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 14))) for _ in range(40)]
    rows = []
    for i in range(160):
        t = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 8)):
            t[rnd.randrange(len(t))] = rnd.choice("abcXYZ！ ")
        rows.append((rnd.choice(["s", "l"]), f"c{i:03d}", rnd.choice(["train", " Train", "dev", "Development", "test ", "TEST", None, "other"]), "".join(t)))
    rows += rows[:9] + [("s", "n1", "train", None), ("s", "n2", "test", ""), ("s", "n3", "test", "short"), ("s", None, "test", base[0]), ("s", "w1", "test", "ＬＡＭＢ ｔｏｆｕ terrace"), ("l", "w2", "train", "lamb-tofu-terrace!!"), ("s", "long", "test", base[0] * 300), ("s", "long2", "train", base[0] * 301)]
    return rows


def overlaps(rows, threshold=0.6, unit="chars", n=3, measure="jaccard"):
    def clean(t):
        low = unicodedata.normalize("NFKC", t).lower()
        return "".join(c for c in low if c.isalnum()) if unit == "chars" else "".join(c if c.isalnum() else " " for c in low).split()

    sides = {"eval": set(), "train": set()}
    for source, i, split, text in rows:
        split = None if split is None else split.strip().lower()
        split = "development" if split == "dev" else split
        if i is not None and text and len("".join(clean(text))) >= 12 and split in ("development", "test", "train"):
            sides["train" if split == "train" else "eval"].add((source, i, split, clean(text) if unit == "chars" else tuple(clean(text))))
    grams = lambda t: {t[k : k + n] for k in range(len(t) - n + 1)}
    out = {}
    for s1, a, split, x in sides["eval"]:
        for s2, b, _, y in sides["train"]:
            p, q = grams(x), grams(y)
            if (s1, a) != (s2, b) and p and q and len(p & q) >= threshold * (len(p | q) if measure == "jaccard" else len(p)):
                out[(s1, split, a, s2, b)] = round(len(p & q) / len(p), 9)
    return out


@pytest.mark.parametrize("index_grams", [2_000_000, 0])
@pytest.mark.parametrize("how", [{}, {"unit": "words", "n": 2, "threshold": 0.5}, {"measure": "containment", "threshold": 0.8}, {"unit": "words", "n": 3, "measure": "containment", "threshold": 1.0}, {"n": 5}])
def test_overlaps_equal_brute_force(spark, monkeypatch, index_grams, how):
    monkeypatch.setattr(so, "INDEX_GRAMS", index_grams)
    monkeypatch.setattr(so, "_HITS", 50)
    rows = request_rows(1)
    inside = rows[0][3] + " extra words of a training text that goes on and on " + rows[1][3] * 3
    rows += [("s", "whole", "train", inside), ("s", "part", "test", rows[0][3])]
    df = spark.createDataFrame(rows, "source string, id string, split string, text string").withColumn("normal", F.lit("clash")).withColumn("block", F.lit(1))
    got = {(r.eval_source, r.eval_split, r.eval_id, r.train_source, r.train_id): round(r.containment, 9) for r in split_overlap(df, **how).collect()}
    assert got == overlaps(rows, **how) and got
    if not how:
        assert ("s", "test", "w1", "l", "w2") in got
    if how.get("measure") == "containment" and how.get("unit") != "words":
        assert ("s", "test", "part", "s", "whole") in got


def test_no_overlap_of_empty_sides(spark):
    df = spark.createDataFrame([("s", "a", "train", "a text that is long enough")], "source string, id string, split string, text string")
    assert split_overlap(df).count() == 0 and split_overlap(df.limit(0)).count() == 0


PROSE = "We came on a Sunday and the waiter was kind to us, but the soup that they brought was cold and we had to wait for the bill. "
COMMON = ("we", "came", "on", "a", "and", "the", "was", "to", "us", "but", "that", "they", "had", "for", "了", "次", "来", "一", "直", "稳", "定", "这", "的", "有", "点", "凉", "不", "过", "服", "务", "员", "很", "耐", "心", "我", "们", "等", "久")


def test_pages_of_each_kind(spark):
    names = [f"word{i}" for i in range(7000)]
    rows = [
        (1, "lamb pie " * 40), (2, " ".join(f"https://a{i}.test/x{i}" for i in range(30))), (3, " ".join(f"#tag{i}" for i in range(30))), (4, " | ".join(f"SKU:soup-{i:05d}" for i in range(30))),
        (5, "Welcome!\n" + ", ".join(f"{d} {m} {p}" for d in ("cod stew", "date pie") for m in ("cheap", "best", "delivery", "coupon") for p in ("Oslo", "Rome", "Lima"))),
        (6, "优惠券火锅外卖，附近火锅团购 优惠券外卖 " * 12), (7, "the the the the the and and and and and " * 9), (8, " ".join(f"item{i} {' '.join(names[i * 60 : i * 60 + 50])} the and was" for i in range(9)) * 6),
        (10, PROSE * 2 + "A friend of mine paid and left early."), (11, PROSE + "#soup #lamb"), (12, "Dinner menu\n" + "\n".join(f"Soup{i} of {names[i]} .... ${i}.50" for i in range(12))),
        (13, "".join(f"See https://a{i}.test/x{i} : {PROSE.replace('soup', names[i]).replace('waiter', names[i + 50]).replace('bill', names[i + 99])}" for i in range(3))), (14, "第27次来了，豆腐锅一直稳定，这次的饼有点凉，不过服务员很耐心，我们等了很久。"), (20, None), (21, ""), (22, " \n\t "), (23, " ".join(f"the {a} was {b} and we had to wait for the {d}" for a, b, d in zip(names, names[2000:], names[4000:]))), (24, "ok"),
    ]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string").withColumn("k", F.lit("clash")).withColumn("recurrence", F.lit(1))
    assert sorted(r.doc_id for r in stuffed_pages(df, words=COMMON).collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert stuffed_pages(df.limit(0)).count() == 0


def test_measures_of_a_beat():
    recurrence, peak, regularity, function, number, unit, distinct, n = measure("lamb pie " * 20, ())
    assert (recurrence, peak, regularity, function, number, unit, distinct, n) == (38 / 40, 38 / 40, 0, 0, 0, 0, 2 / 40, 40)
    far = measure(" ".join(f"w{i % 60}" for i in range(600)), ())
    assert far[0] == far[1] == 0 and far[2] == 540 / 600  # a period of 60 words is beyond every window, but regular
    links = measure("see https://a.test/x www.b.test <a href='q'>soup</a> [d](e) eats.test f(.)test/g #tag k:v 12", ("see",))
    assert links[3:6] == (1 / 10, 1 / 10, 8 / 10)
    assert measure(None, ()) == measure("", ()) == measure(" \n ", ()) == (0.0,) * 8


def test_odd_long_texts_cost_their_length():
    began = time.perf_counter()
    for text in ("x" * 300_000 + " a.b.test/c", "[" * 200_000 + "](", "a." * 200_000, "a . " * 100_000 + "test", "<a " * 100_000 + "http", "-" * 300_000 + ".a", "#" * 200_000, "a:" * 100_000 + "-" * 100_000, "(.)" * 100_000):
        assert measure(text, ())[-1] >= 0
    assert time.perf_counter() - began < 20


def test_function_words_are_those_of_a_language(spark):
    rows = [("The soup was good and Ann came", "en"), ("the lamb was cold and Bob left", " EN")] * 30 + [("die Suppe war gut", "de")] * 12 + [(None, "en"), ("", "de"), ("la sopa", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string")
    assert {r.word for r in function_words(df, "text", "lang").collect()} == {"the", "soup", "was", "good", "and", "ann", "came", "lamb", "cold", "bob", "left", "die", "suppe", "war", "gut", "la", "sopa"} - {"la", "sopa"}
    assert {r.word for r in function_words(df, "text", share=0.6).collect()} == {"the", "was", "and"}
    assert function_words(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_pages_agree_with_the_labels(spark, folder):
    folder = f"/root/testdata/{folder}"
    flagged = {r.doc_id for r in llm.p9_found(spark, folder).collect()}
    votes = {}
    for r in spark.read.parquet(f"{folder}/page_labels.parquet").where("page_label <> 'unsure'").collect():
        votes.setdefault(r.doc_id, []).append(r.page_label == "spam")
    clear = {d: all(v) for d, v in votes.items() if len(set(v)) == 1}
    assert sum((d in flagged) == spam for d, spam in clear.items()) / len(clear) > 0.97


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    from oracle import assert_same

    assert_same(spark, "/root/testdata/sf0.001", llm.queries()[name], llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql()) - {"p9_found"}))
def test_query_runs(spark, name):
    assert llm.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
