import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R
from lodestone.operators import text as T
from lodestone.operators.filters import category_match, hard_filter
from lodestone.operators.learning import batch_score, linear, pairwise_logistic
from lodestone.operators.state import fold_patches


def test_item_neighbours_closed_form(spark):
    rows = [("u1", "a", 5.0), ("u1", "b", 4.0), ("u2", "a", 4.0), ("u2", "b", 5.0), ("u3", "a", 5.0), ("u4", "b", 3.0), ("u5", "a", 1.0), ("u5", "c", 2.0)]
    events = spark.createDataFrame([(u, b, s, f"r{i}") for i, (u, b, s) in enumerate(rows)], "user_id string, business_id string, stars double, review_id string").withColumn("t", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {(r.feedback, r.i, r.j): (r.support, r.similarity) for r in R.item_pairs(events, beta=1.0).collect()}
    assert got == {("positive", "a", "b"): (2, pytest.approx(2 / math.sqrt(6) * 2 / 3, abs=1e-8)), ("negative", "a", "c"): (1, 0.5)}


def test_bounded_reorder_keeps_moves_in_bounds(spark):
    rnd = random.Random(5)
    rows = [("t", f"i{r:02d}", r, rnd.random()) for r in range(1, 26)]
    got = R.bounded_reorder(spark.createDataFrame(rows, "task string, item string, r int, s double"), "task", "item", "r", "s").collect()
    assert sorted(r.new_rank for r in got) == list(range(1, 26))
    assert all(-3 <= r.base_rank - r.new_rank <= 5 for r in got)


def test_hard_filter_counts_unknown_and_charges_the_first_failure(spark):
    df = spark.createDataFrame([(1, True, 1), (2, None, 1), (3, False, None), (4, True, None), (5, True, 9)], "id int, open boolean, price int")
    kept, audit = hard_filter(df, [("open", F.col("open")), ("cheap", F.col("price") <= 2)])
    assert [r.id for r in kept.collect()] == [1]
    assert [tuple(r) for r in audit.orderBy("step").collect()] == [(1, "open", 5, 3, 2, 1), (2, "cheap", 3, 1, 2, 1)]
    assert [r["after"] for r in hard_filter(df.limit(0), [("open", F.col("open"))])[1].collect()] == [0]


def test_category_match_modes(spark):
    df = spark.createDataFrame([(["Tapas Bars", "Vegan"],), (["Vegan"],), (None,)], "x array<string>")
    got = df.select(*(category_match(F.col("x"), ["Bars", "Vegan"], m, {"Bars": ["Tapas Bars"]}).alias(m) for m in ("any", "all", "none"))).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, False, False), (None, None, None)]


def test_hours_tri_state_and_names(spark):
    rows = [(600, 1200, 700), (1200, 120, 60), (600, 600, 600), (None, 60, 30)]
    got = spark.createDataFrame(rows, "a int, b int, m int").select(S.open_at(F.col("a"), F.col("b"), F.col("m")).alias("o")).collect()
    assert [r.o for r in got] == [True, True, False, None]
    df = spark.createDataFrame([("u'free'", "RestaurantsPriceRange_2"), ("'no'", "GoodForKids"), ("maybe", "a__b")], "v string, k string")
    assert [tuple(r) for r in df.select(S.tri_state(F.col("v")), S.humanize(F.col("k"))).collect()] == [(True, "restaurants price range 2"), (False, "good for kids"), (None, "a b")]


def test_hash_fold_is_the_whole_hash(spark):
    import hashlib

    rows = [(f"u{i}",) for i in range(50)]
    got = {r.u: r.f for r in spark.createDataFrame(rows, "u string").select("u", S.hash_fold("s", F.col("u"), 5).alias("f")).collect()}
    assert got == {u: int(hashlib.sha256(f"s:{u}".encode()).hexdigest(), 16) % 5 + 1 for (u,) in rows}


def brute_passages(text, overlap, max_chars=900):
    """Passages by trying every prefix: sentences are found by looking at each place between two characters."""
    closing = ".!?" if overlap else ".!?。！？"
    ends = []
    for p in range(1, len(text) + 1):
        run = p
        while run > 0 and text[run - 1].isspace():
            run -= 1
        after_mark = 0 < run < p and text[run - 1] in closing and (p == len(text) or not text[p].isspace())
        in_marked_run = 0 < run < p and text[run - 1] in closing
        line_end = text[p - 1] == "\n" and (p == len(text) or text[p] != "\n") and not in_marked_run
        wide = overlap and text[p - 1] in "。！？"
        if p == len(text) or after_mark or line_end or wide:
            ends.append(p)
    pieces, begin = [], 0
    for end in ends:
        while end - begin > max_chars:
            cut = next((i for i in range(begin + max_chars, begin, -1) if text[i] == " " or overlap and text[i] == "\t"), begin + max_chars)
            pieces.append((begin, cut))
            begin = cut
        if not overlap or text[begin:end].strip():
            pieces.append((begin, end))
        begin = end
    out, i = [], 0
    while i < len(pieces):
        j = i
        while j + 1 < len(pieces) and pieces[j + 1][1] - pieces[i][0] <= max_chars:
            j += 1
        if text[pieces[i][0] : pieces[j][1]].strip():
            out.append((pieces[i][0], pieces[j][1]))
        if j + 1 == len(pieces):
            break
        i = j if overlap and j > i else j + 1
    return out


@pytest.mark.parametrize("overlap", [False, True])
def test_chunks_equal_a_search_of_every_place(overlap):
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice(["word ", "longerword ", "x. ", "y! \n", "。", "？ ", "\n\n", "\t", "z?\t", "q" * rnd.randrange(1, 400), " "]) for _ in range(rnd.randrange(0, 160)))
        assert T.chunks(text, overlap=overlap) == brute_passages(text, overlap), repr(text)


def test_passages_lie_in_the_text():
    rnd = random.Random(0)
    for overlap in (False, True):
        text = " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 12))) + rnd.choice(["", "", ".", "!", "\n"]) for _ in range(900)) + "x" * 1200
        spans, more = T.passages(text, overlap)
        assert (len(spans) <= 8) is not overlap and more is not overlap and all(0 <= a < b <= len(text) and b - a <= 900 and text[a:b] == text[a:b].strip() for _, a, b in spans)
    assert T.passages("   ") == ([], False) and T.passages("ok") == ([(0, 0, 2)], False)


def test_aspects_flip_on_negation_and_mix():
    read = T.AspectReader({"service": (("helpful",), ("rude",)), "noise": (("calm",), ("loud",))})
    text = "The staff was not helpful, but the room was calm. Rude and helpful waiter. Not once did the very helpful Dr. Loud speak"
    got = [(a, s, p, text[i:j]) for a, s, p, i, j in read(text)]
    assert got == [("service", "negative", 0.72, "The staff was not helpful"), ("noise", "positive", 0.85, "the room was calm"), ("service", "mixed", 0.60, "Rude and helpful waiter"), ("service", "positive", 0.85, "Not once did the very helpful Dr. Loud speak"), ("noise", "negative", 0.85, "Not once did the very helpful Dr. Loud speak")]
    assert read("") == [] and T.AspectReader({})("helpful") == []


def test_protection_walks_every_displaced_item(spark):
    # base 1 2 3 all displaced: d meets a (0.6 - 0.5 < 0.2, swapped), e meets b (enough, stays), f meets b (0.9 - 0.8 < 0.2, swapped)
    rows = [("t", "d", 1, 4, 0.5, True), ("t", "e", 2, 6, 0.1, True), ("t", "f", 3, 5, 0.8, True), ("t", "a", 4, 3, 0.6, True), ("t", "b", 5, 2, 0.9, True), ("t", "g", 6, 1, 0.95, True)]
    df = spark.createDataFrame(rows, "task string, item string, base int, new int, score double, ok boolean")
    got = {r.item: r.final_rank for r in R.protect_top(df, "task", "item", "new", "base", "score", evidence="ok").collect()}
    assert got == {"d": 3, "a": 4, "e": 6, "b": 5, "f": 2, "g": 1}
    doubted = {r.item: r.final_rank for r in R.protect_top(df.withColumn("ok", F.lit(None).cast("boolean")), "task", "item", "new", "base", "score", evidence="ok").collect()}
    assert doubted == {"d": 3, "a": 4, "e": 2, "b": 6, "f": 1, "g": 5}


def test_balanced_selection_covers_rare_labels_first(spark):
    rows = [("c", f"i{k}", ["common"] + (["rare"] if k == 7 else []) + (["mid"] if k in (2, 5) else []), float(k)) for k in range(9)] + [("c", "none", None, 99.0), ("c", "i0", ["common"], 0.0)]
    got = [(r.i, r.reason) for r in R.greedy_balanced(spark.createDataFrame(rows, "g string, i string, l array<string>, q double"), "g", "i", "l", 5, "q").orderBy("order").collect()]
    assert got == [("i7", "first"), ("i5", "first"), ("i8", "balance"), ("i2", "balance"), ("i6", "balance")]
    assert len(R.greedy_balanced(spark.createDataFrame(rows, "g string, i string, l array<string>, q double"), "g", "i", "l", 20, "q").collect()) == 10


def test_metrics_with_missing_ranks_and_status(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (10,)], "r bigint")
    row = df.agg(*(a.alias(n) for n, a in M.single_positive(F.col("r")).items())).first()
    assert (row.hr_1, row.hr_3, row.hr_5) == (0.25, 0.5, 0.5) and row.mrr == pytest.approx((1 + 1 / 3 + 0.1) / 4, abs=1e-8) and row.ndcg_5 == pytest.approx((1 + 0.5) / 4)
    status = spark.createDataFrame([(1, 2), (0, 0), (None, 1)], "a int, b int").select(M.with_status(F.col("a"), F.col("b")).alias("s")).collect()
    assert [tuple(r.s) for r in status] == [("measured", 0.5), ("not_applicable", None), ("unavailable", None)]


def test_multi_relevant_counts_the_ideal(spark):
    ranking = spark.createDataFrame([("t", f"i{r}", r) for r in range(1, 7)], "task string, item string, rank int")
    relevant = spark.createDataFrame([("t", "i1"), ("t", "i3"), ("t", "zz"), ("u", "i1")], "task string, item string")
    got = {r.task: (r.hits, r.mrr, r.ndcg) for r in M.multi_relevant(ranking, relevant, "task", "item").collect()}
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert got == {"t": (2, 1.0, pytest.approx(1.5 / ideal, abs=1e-8)), "u": (0, 0.0, 0.0)}


def test_bootstrap_covers_a_clear_difference(spark):
    rows = [(f"u{i % 60}", 1.0 if i % 3 else 0.0, 0.0) for i in range(600)]
    r = M.paired_bootstrap(spark.createDataFrame(rows, "u string, a double, b double"), "u", "a", "b").first()
    assert r.low <= r.delta <= r.high and r.low > 0 and r.share_above_zero == 1.0


def test_pairwise_logistic_finds_the_useful_feature_and_refuses_labels(spark):
    rnd = random.Random(8)
    rows = [(rnd.gauss(1, 1), rnd.gauss(0, 1)) for _ in range(400)]
    pairs = spark.createDataFrame(rows, "good double, noise double")
    w = pairwise_logistic(pairs, ["good", "noise"])
    assert w[0] > 0.5 and abs(w[1]) < 0.4
    scored = batch_score(pairs.withColumn("id", F.monotonically_increasing_id()), ["id"], ["good", "noise"], linear(w))
    assert scored.columns == ["id", "score"] and scored.count() == 400
    with pytest.raises(ValueError):
        batch_score(pairs.withColumn("label", F.lit(1)), ["good"], ["label"], linear([1.0]))


def test_patches_need_confidence_evidence_and_explicit_removal():
    p = lambda op, slot, value=None, hard=False, confidence=1.0, evidence="x", **k: {"operation": op, "slot": slot, "value": value, "hard": hard, "confidence": confidence, "evidence": evidence, **k}
    state = fold_patches([p("add", "city", "A", hard=True), p("replace", "city", "B"), p("remove", "city"), p("add", "price", 1, confidence=0.1), p("add", "noise", "low"), p("replace", "noise", "mid"), p("add", "seat", 1, evidence="")])
    assert state == {"city": {"value": "A", "hard": True}, "noise": {"value": "mid", "hard": False}}
    assert fold_patches([p("add", "city", "A", hard=True), p("remove", "city", explicit=True)]) == {}
    assert json.dumps(fold_patches([])) == "{}"


def test_preference_signals_ignore_order(spark):
    from lodestone.operators.evidence import decayed_signal

    rows = [("u", 1.0, 1.0, "2024-01-01"), ("u", -1.0, 0.5, "2023-01-01"), ("u", 1.0, 0.5, "2022-01-01")]
    make = lambda r: spark.createDataFrame(r, "u string, direction double, confidence double, d string").selectExpr("u", "direction", "confidence", "cast(d as timestamp_ntz) event_time", "timestamp_ntz'2024-06-01' cutoff_time")
    assert decayed_signal(make(rows), ["u"]).collect() == decayed_signal(make(rows[::-1]), ["u"]).collect()


def test_comma_list_trims_and_drops_blanks(spark):
    got = spark.createDataFrame([(" Bars , Vegan,, ",), (None,)], "x string").select(S.comma_list(F.col("x")).alias("l")).collect()
    assert [r.l for r in got] == [["Bars", "Vegan"], None]


@pytest.mark.parametrize("slice_events", [200_000, 30])
def test_candidates_are_as_of_each_task(spark, monkeypatch, slice_events):
    import lodestone.operators.catalogue as K

    monkeypatch.setattr(K, "SLICE_EVENTS", slice_events)
    rnd = random.Random(1)
    items = spark.createDataFrame([(f"b{i}", 40 + i / 100, None if i == 3 else -70.0, ["x", "y", None][: i % 3 + 1] if i != 4 else None) for i in range(12)], "business_id string, latitude double, longitude double, categories array<string>")
    day = lambda n: f"2024-01-{1 + n // 24:02d} {n % 24:02d}:00:00"
    raw = [(f"u{rnd.randrange(9)}" if rnd.random() < 0.7 else "hot", f"b{rnd.randrange(14)}", float(rnd.randrange(1, 6)), rnd.randrange(600)) for _ in range(400)]
    events = spark.createDataFrame([(u, b, s, day(t)) for u, b, s, t in raw], "user_id string, business_id string, stars double, d string").selectExpr("user_id", "business_id", "stars", "cast(d as timestamp_ntz) t")
    asked = [(f"t{i}", rnd.choice(["u1", "u2", "hot", "nobody"]), rnd.randrange(600)) for i in range(40)]
    tasks = spark.createDataFrame([(k, u, day(t)) for k, u, t in asked] + [("null", None, day(3))], "task_id string, user_id string, d string").selectExpr("task_id", "user_id", "cast(d as timestamp_ntz) cutoff_time")
    known = K.catalogue(items)
    got = {}
    for r in K.candidates(events, tasks, known, "quality", 5).collect():
        got.setdefault(r.task_id, []).append((r["rank"], r.business_id, r.quality))
    assert "null" not in got
    for k, u, t in asked:
        past = [(x, b, s) for x, b, s, at in raw if at < t and b in known.ids]
        n = {b: sum(x[1] == b for x in past) for b in known.ids}
        stars = {b: sum(x[2] for x in past if x[1] == b) for b in known.ids}
        seen = [b for b in known.ids if n[b]]
        if not seen:
            assert k not in got
            continue
        mean, logs = sum(stars.values()) / sum(n.values()), sorted(math.log1p(n[b]) for b in seen)
        at = 0.95 * (len(logs) - 1)
        p95 = logs[int(at)] + (at - int(at)) * (logs[min(int(at) + 1, len(logs) - 1)] - logs[int(at)])
        quality = {b: 0.8 * min(1, max(0, ((stars[b] + 20 * mean) / (n[b] + 20) - 1) / 4)) + 0.2 * min(math.log1p(n[b]), p95) / p95 for b in seen}
        own = {b for x, b, _ in past if x == u}
        best = sorted((b for b in seen if b not in own), key=lambda b: (-round(quality[b], 9), known.ids.index(b)))[:5]
        rows = sorted(got.get(k, []))
        assert [b for _, b, _ in rows] == best and all(q == pytest.approx(quality[b], abs=2e-9) for _, b, q in rows)
    with pytest.raises(ValueError):
        K.catalogue(items, limit=5)
    assert K.candidates(events.limit(0), tasks, known, "fused", 5, weights={"quality": 1.0, "location": 1.0}).count() == 0


@pytest.mark.parametrize("slices", [1, 7])
def test_sessions_folded_in_slices_equal_one_fold(spark, slices):
    from lodestone.operators.state import fold_sessions

    rnd = random.Random(11)
    rows = []
    for i in range(400):
        p = {"operation": rnd.choice(["add", "replace", "remove"]), "slot": rnd.choice("ab"), "value": rnd.randrange(9), "hard": rnd.random() < 0.2, "confidence": rnd.choice([0.9, 0.9, 0.3]), "evidence": rnd.choice(["x", "x", ""]), "explicit": rnd.random() < 0.2}
        rows.append((rnd.choice(["hot", "hot", "u", "v"]), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", json.dumps(p)))
    df = spark.createDataFrame(rows + [("u", None, "{}"), (None, "2024-01-01 00:00:00", "{}"), ("u", "2024-01-01 00:00:00", None)], "s string, d string, p string").selectExpr("s", "cast(d as timestamp_ntz) t", "p")
    got = {(r.s, r.slot): (json.loads(r.value), r.hard) for r in fold_sessions(df, "s", "t", "p", slices).collect()}
    expected = {}
    for s in ("hot", "u", "v"):
        for slot, state in fold_patches(json.loads(p) for who, _, p in rows if who == s).items():
            expected[(s, slot)] = (state["value"], state["hard"])
    assert got == expected


def test_json_is_flattened_at_any_depth(spark):
    df = spark.createDataFrame([("a", '{"x": {"y": [1, {"z": true}], "n": null}, "w": "u\'free\'"}'), ("b", "broken"), ("c", None), ("d", "{}")], "id string, j string")
    got = sorted((r.id, tuple(r.path), r.value) for r in T.flatten_json(df, "id", "j").collect())
    assert got == [("a", ("w",), "u'free'"), ("a", ("x", "y"), "1"), ("a", ("x", "y", "z"), "true")]


def test_catalogue_search_prefers_whole_names(spark):
    names = spark.createDataFrame([("Hot Pot",), ("Pot Pie",), ("火锅店",)], "name string")
    asked = spark.createDataFrame([("1", "a hot pot near pie"), ("2", "附近的火锅"), ("3", None), ("4", "nothing")], "q string, t string")
    got = [(r.q, r.name, r["rank"]) for r in T.catalogue_search(asked, "q", "t", names, "name", 5).orderBy("q", "rank").collect()]
    assert got == [("1", "Hot Pot", 1), ("1", "Pot Pie", 2), ("2", "火锅店", 1)]


def test_week_includes_the_night_before(spark):
    rows = [(600, 1200, None, None, 700), (600, 1200, 1300, 100, 50), (600, 600, None, None, 600), (None, None, 1300, 100, 50), (None, None, None, None, 50), (1300, 100, 600, 700, 50), (1300, 100, 600, 700, 1310)]
    got = spark.createDataFrame(rows, "a int, b int, pa int, pb int, m int").select(S.open_in_week(*map(F.col, ("a", "b", "pa", "pb", "m"))).alias("o")).collect()
    assert [r.o for r in got] == [True, True, False, True, None, False, True]


def test_calibrators_fit_what_they_should(spark):
    rnd = random.Random(6)
    rows = [(x, int(rnd.random() < 1 / (1 + math.exp(-(0.5 + 2 * x))))) for x in (rnd.gauss(0, 1) for _ in range(4000))]
    a, b = M.logistic_calibrator(spark.createDataFrame(rows + [(None, 1)], "x double, y int"), "x", "y")
    assert abs(a - 0.5) < 0.15 and abs(b - 2) < 0.2
    assert M.logistic_calibrator(spark.createDataFrame([], "x double, y int"), "x", "y") == (0.0, 0.0)
    counts = [(1, 4, 1), (2, 4, 3), (3, 4, 1), (4, 2, 1), (5, 1, 1), (6, 3, 2)]
    df = spark.createDataFrame([(s, int(i < good)) for s, n, good in counts for i in range(n)], "s int, o int")
    got = {r.s: r.fitted for r in M.isotonic(df, "s", "o").collect()}
    mean = lambda j, k: sum(g for s, _, g in counts if j <= s <= k) / sum(n for s, n, _ in counts if j <= s <= k)
    assert got == {i: pytest.approx(max(min(mean(j, k) for k in range(i, 7)) for j in range(1, i + 1))) for i in range(1, 7)}
    with pytest.raises(ValueError):
        M.isotonic(df, "s", "o", most=3)


def test_boosted_trees_rank_the_wanted_item_first(spark):
    from lodestone.operators.trees import LambdaMart, lambdas

    rnd = random.Random(9)
    rows = []
    for t in range(150):
        items = [(rnd.random(), rnd.random(), rnd.random()) for _ in range(12)]
        wanted = max(range(12), key=lambda i: -abs(items[i][0] - 0.5) + 0.02 * items[i][1])  # no linear score finds it
        rows += [(f"t{t}", f"i{i}", *(None if rnd.random() < 0.02 else v for v in x), int(i == wanted)) for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "task string, item string, a double, b double, noise double, y int")
    model = LambdaMart(["a", "b", "noise"], rounds=6, depth=2, least_rows=5).fit(df, "task", "y")
    scored = batch_score(df.select("task", "item", F.col("y").alias("kept"), "a", "b", "noise"), ["task", "item", "kept"], ["a", "b", "noise"], model.scorer()).collect()
    places = []
    for t in {r.task for r in scored}:
        own = sorted((r for r in scored if r.task == t), key=lambda r: -r.score)
        places.append([r.kept for r in own].index(1) + 1)
    assert sum(1 / p for p in places) / len(places) > 0.6 and {int(f) for tree in model.trees for f in tree.feature if f >= 0} >= {0}
    g, h = lambdas(np.array([0.0, 1.0, 2.0]), np.array([1, 0, 0]))
    assert g[0] > 0 > g[1] and abs(g.sum()) < 1e-12 and (h > 0).all()
    assert LambdaMart(["a"]).fit(df.limit(0), "task", "y").trees == []
