import random

import numpy as np
import pytest

from lodestone.llm.packing import COST_SHARE, best_fit, pack, pack_texts


def test_texts_keep_a_given_attention_cost(spark):
    df = spark.createDataFrame([(i, "word " * 9) for i in range(40)], "doc_id bigint, text string")
    fill = {}
    for r in pack_texts(df, capacity=100, max_cost=300.0).collect():
        fill.setdefault(r.container_id, []).append(r.size)
    assert all(sum(s * s for s in x) <= 300 for x in fill.values()) and max(map(len, fill.values())) > 1
    free = {}
    for r in pack_texts(df, capacity=100).collect():
        free.setdefault(r.container_id, []).append(r.size)
    assert len(free) < len(fill)


def one_by_one(sizes, capacity, max_items, max_cost, weights=(1.0, 0.01, 0.05)):
    """Best fit by the norm, an item at a time."""
    top = (capacity, max_items, max_cost)
    open_, where, opened = [], [], 0
    for size in sizes:
        item = (size, 1, size * size)
        fits = [b for b in open_ if all(f >= x for f, x in zip(b[1], item))]
        if fits:
            best = min(fits, key=lambda b: (round(sum(w * ((f - x) / t) ** 2 for w, f, x, t in zip(weights, b[1], item, top)), 12), b[0]))
            best[1] = [f - x for f, x in zip(best[1], item)]
        else:
            best = [opened, [t - x for t, x in zip(top, item)]]
            opened += 1
            open_.append(best)
        where.append(best[0])
        open_ = [b for b in open_ if b[1][0] > 0 or size == 0]
    return where


@pytest.mark.parametrize("limits", [(64, 5, 3000.0), (64, 100, 4096 * COST_SHARE), (40, 3, 900.0)])
def test_runs_of_equal_sizes_are_placed_as_one_by_one(limits):
    rnd = random.Random(8)
    for n in (0, 1, 7, 300):
        sizes = sorted((rnd.choice([0, 1, 3, 3, 10, 20, 20, 33, rnd.randrange(limits[0] + 1)]) for _ in range(n)), reverse=True)
        got, wanted = best_fit(np.array(sizes, np.int64), *limits), one_by_one(sizes, *limits)
        # which of several equally filled containers an item meets is free, so fills are compared
        fill = lambda where: sorted(tuple(sorted(s for s, b in zip(sizes, where) if b == x)) for x in set(where))
        assert fill(got.tolist()) == fill(wanted)


def test_the_default_attention_cost_binds(spark):
    df = spark.createDataFrame([(1, 95), (2, 5), (3, 50), (4, 50)], "id bigint, n bigint")
    at = {r.id: r.container_id for r in pack(df, "id", "n", capacity=100).collect()}
    assert at[1] != at[2]  # 95 squared is over the share, so the long item stands alone
    assert len({at[3], at[4]}) == 1
    loose = {r.id: r.container_id for r in pack(df, "id", "n", capacity=100, max_cost=10_000.0).collect()}
    assert loose[1] == loose[2]
