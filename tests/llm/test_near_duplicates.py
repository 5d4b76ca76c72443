import random
import re

import numpy as np
import pytest

import lodestone.llm.near_duplicates as near
from lodestone.llm.components import connected_components
from lodestone.llm.near_duplicates import NearDuplicates
from lodestone.llm.superminhash import signatures

SCHEMA = "kind string, id string, text string, key int, words string"


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(15, 60))] for _ in range(60)]
    for base in list(texts[:30]):
        for _ in range(3):
            t = list(base)
            for _ in range(rnd.randrange(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            texts.append(t)
    rows = [(rnd.choice(["a", "a", "b"]), f"i{i:03d}", rnd.choice([" ", ", "]).join(t).title(), 1, "x") for i, t in enumerate(texts)]
    rows += [("a", "copy1", rows[0][2], 1, "x"), ("a", "copy2", rows[0][2], 1, "x"), rows[3], rows[3], ("a", rows[5][1], rows[6][2], 1, "x")]
    return rows + [("a", "null", None, 1, "x"), ("a", None, rows[0][2], 1, "x"), ("a", "empty", "", 1, "x"), ("a", "short", "two words", 1, "x"), ("b", "long", " ".join(vocabulary * 40), 1, "x"), ("b", "long2", " ".join(vocabulary * 41), 1, "x")]


def brute(rows, threshold, shingle, min_words=20):
    sets = {}
    for kind, i, text, *_ in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if kind is not None and i is not None and len(words) >= min_words:
            sets[(kind, i, text)] = {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}
    out = set()
    for (k1, a, _), x in sets.items():
        for (k2, b, _), y in sets.items():
            if k1 == k2 and a < b and len(x & y) >= threshold * len(x | y):
                out.add((k1, a, b))
    return out


@pytest.mark.parametrize("threshold, shingle", [(0.5, 3), (0.8, 5)])
def test_pairs_equal_brute_force(spark, threshold, shingle):
    rows = corpus()
    found = NearDuplicates(spark.createDataFrame(rows, SCHEMA), threshold, shingle)
    assert {tuple(r) for r in found.pairs().collect()} == brute(rows, threshold, shingle)


def test_groups_are_the_connected_parts(spark):
    rows = corpus(2)
    got = NearDuplicates(spark.createDataFrame(rows, SCHEMA), 0.5, 3).groups().collect()
    pairs = brute(rows, 0.5, 3)
    ids = {(k, i) for k, i, t, *_ in rows if k is not None and i is not None and t is not None}
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a, b in pairs:
        x, y = root((k, a)), root((k, b))
        parent[max(x, y)] = min(x, y)
    assert {(r.kind, r.id): r.group_id for r in got} == {x: root(x)[1] for x in ids}
    assert len(got) == len(ids)
    links = {(r.kind, r.id): r.n_links for r in got}
    assert all((links[x] > 0) == any(x in ((k, a), (k, b)) for k, a, b in pairs) for x in ids)


def test_blocks_and_shuffled_candidates_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(near, "ENTRIES_PER_TASK", 40)
    monkeypatch.setattr(near, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(near, "_FLUSH_ROWS", 10)
    monkeypatch.setattr(near, "TILE", 3)
    assert {tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA), 0.5, 3).pairs().collect()} == brute(rows, 0.5, 3)


def test_a_hot_text_is_not_compared_with_itself(spark):
    rows = [("a", f"c{i:03d}", " ".join(f"w{j}" for j in range(30))) for i in range(40)] + [("a", "other", " ".join(f"w{j}" for j in range(1, 31)))]
    found = NearDuplicates(spark.createDataFrame(rows, "kind string, id string, text string"), 0.8, 5)
    assert found.candidates().count() == 1
    assert found.pairs().count() == 41 * 40 // 2
    assert {r.n_links for r in found.groups().collect()} == {40}


def test_no_records(spark):
    empty = NearDuplicates(spark.createDataFrame([], "kind string, id string, text string"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_signature_estimates_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(0)
    m, trials, errors = 64, 300, []
    for _ in range(trials):
        x = rng.integers(0, 2**63, 60, dtype=np.uint64)
        sets = np.concatenate((x[:40], x[20:]))  # Jaccard 20 / 60
        s = signatures(sets, np.repeat([0, 1], 40), 2, m)
        errors.append((s[0] == s[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02
    assert np.var(errors) < 0.85 * (1 / 3) * (2 / 3) / m


def test_signature_is_the_least_offer_of_each_place():
    x = np.arange(1, 8, dtype=np.uint64) * np.uint64(12345678912345)
    whole = signatures(x, np.zeros(7, np.int64), 1, 16)[0]
    alone = signatures(x, np.arange(7), 7, 16)
    assert (whole == alone.min(axis=0)).all()
    assert (np.sort(alone >> np.uint64(32), axis=1) == np.arange(16)).all()  # each element ranks every place once


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)]
    rows = chain + [(1000, i) for i in range(1001, 1050)] + [(5, 5), (1001, 1000), (3000, 2999), (None, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1050)} | {3000: 2999, 2999: 2999}
    assert connected_components(df.limit(0)).count() == 0
