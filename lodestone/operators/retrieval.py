"""As-of routes, rank fusion and reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S

c = F.col
#: Scores are compared after rounding, so the order of a sum never decides a rank.
DIGITS = 9


def route_top(df: DataFrame, task: str, item: str, score: str, n: int, keep_zero: bool = True) -> DataFrame:
    """``df`` with rank from 1 by falling score, then item; the first ``n`` of each task."""
    rows = df if keep_zero else df.where(c(score) > 0)
    rows = rows.withColumn(score, F.round(c(score), DIGITS))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(task).orderBy(c(score).desc(), item))).where(c("rank") <= n)


def history_of(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """(task_id, business_id, stars, t) of the task's user strictly before its cutoff."""
    return tasks.select("task_id", "user_id", "cutoff_time").join(events.select("user_id", "business_id", "stars", "t"), "user_id").where("t < cutoff_time").select("task_id", "business_id", "stars", "t")


def protected_union(base: DataFrame, extra: DataFrame, excluded: DataFrame, task: str, item: str) -> DataFrame:
    """(task, item, in_base, in_extra): all rows of both lists but the excluded; nothing is cut."""
    a, b = base.select(task, item, F.lit(1).alias("a")), extra.select(task, item, F.lit(1).alias("b"))
    both = a.join(b, [task, item], "full").join(excluded.select(task, item).distinct(), [task, item], "left_anti")
    return both.select(task, item, c("a").isNotNull().alias("in_base"), c("b").isNotNull().alias("in_extra"))


def item_pairs(events: DataFrame, half_life_days: float = 365.0, beta: float = 10.0) -> DataFrame:
    """(feedback, i, j, cooccurrence, support, similarity), i < j: items that users rated alike.

    Per user and item the latest rating counts: 4 and more is positive, 2 and less negative, else it drops out. Weights
    halve every ``half_life_days`` before the last event. Similarity is the cosine of the weighted co-occurrence, shrunk
    by support / (support + beta). A user meets itself once for each pair of rated items, which is what is counted; a
    user's partition that grows beyond the others is split by the adaptive skew join.
    """
    latest = events.groupBy("user_id", "business_id").agg(F.max(F.struct("t", "review_id", "stars")).alias("x")).select("user_id", "business_id", "x.stars", "x.t")
    sign = F.when(c("stars") >= 4, "positive").when(c("stars") <= 2, "negative")
    rated = latest.withColumn("feedback", sign).where("feedback is not null")
    end = events.agg(F.max("t").alias("end"))  # one row
    weighted = rated.crossJoin(F.broadcast(end)).select("user_id", "business_id", "feedback", S.half_life_weight(S.age_days(c("t"), c("end")), half_life_days).alias("w"))
    popular = weighted.groupBy("feedback", "business_id").agg(F.sum("w").alias("popularity"))
    other = weighted.select("user_id", "feedback", c("business_id").alias("j"), c("w").alias("w2"))
    pairs = weighted.join(other, ["user_id", "feedback"]).where("business_id < j").groupBy("feedback", c("business_id").alias("i"), "j").agg(F.sum(F.sqrt(c("w") * c("w2"))).alias("cooccurrence"), F.count("*").alias("support"))
    left, right = popular.select("feedback", c("business_id").alias("i"), c("popularity").alias("pi")), popular.select("feedback", c("business_id").alias("j"), c("popularity").alias("pj"))
    similarity = c("cooccurrence") / F.sqrt(c("pi") * c("pj")) * c("support") / (c("support") + beta)
    return pairs.join(left, ["feedback", "i"]).join(right, ["feedback", "j"]).select("feedback", "i", "j", F.round("cooccurrence", DIGITS).alias("cooccurrence"), "support", F.round(similarity, DIGITS).alias("similarity"))


def item_scores(events: DataFrame, pairs: DataFrame, half_life_days: float = 365.0) -> DataFrame:
    """(user_id, business_id, positive_score, negative_score): seed-weighted mean similarity, the two signs apart; items of the user's own history are left out."""
    latest = events.groupBy("user_id", "business_id").agg(F.max(F.struct("t", "review_id", "stars")).alias("x")).select("user_id", "business_id", "x.stars", "x.t")
    seeds = latest.withColumn("feedback", F.when(c("stars") >= 4, "positive").when(c("stars") <= 2, "negative")).where("feedback is not null")
    end = events.agg(F.max("t").alias("end"))
    seeds = seeds.crossJoin(F.broadcast(end)).select("user_id", "feedback", c("business_id").alias("i"), S.half_life_weight(S.age_days(c("t"), c("end")), half_life_days).alias("w"))
    total = seeds.groupBy("user_id", "feedback").agg(F.sum("w").alias("total"))
    both = pairs.select("feedback", "i", "j", "similarity").union(pairs.select("feedback", c("j"), c("i"), "similarity"))
    mass = seeds.join(both, ["feedback", "i"]).groupBy("user_id", "feedback", "j").agg(F.sum(c("w") * c("similarity")).alias("mass")).join(total, ["user_id", "feedback"])
    of = lambda name: F.round(F.coalesce(F.max(F.when(c("feedback") == name, c("mass") / c("total"))), F.lit(0.0)), DIGITS)
    scores = mass.groupBy("user_id", c("j").alias("business_id")).agg(of("positive").alias("positive_score"), of("negative").alias("negative_score"))
    return scores.join(latest.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti")


def blend(df: DataFrame, task: str, item: str, left: str, right: str, alpha: float) -> DataFrame:
    """``df`` with blend = alpha * percentile of ``left`` + (1 - alpha) * percentile of ``right``, and its rank."""
    w = Window.partitionBy(task)
    size = F.count("*").over(w)
    percentile = lambda s: S.rank_percentile(F.row_number().over(w.orderBy(c(s).desc(), item)), size)
    scored = df.withColumn("blend", F.round(alpha * percentile(left) + (1 - alpha) * percentile(right), DIGITS))
    return scored.withColumn("rank", F.row_number().over(w.orderBy(c("blend").desc(), item)))


def layered_order(*tiers: tuple[Column, bool]) -> list[Column]:
    """Lexicographic order of (column, descending) with nulls last."""
    return [(x.desc_nulls_last() if down else x.asc_nulls_last()) for x, down in tiers]


def bounded_reorder(df: DataFrame, task: str, item: str, base_rank: str, score: str, up: int = 5, down: int = 3) -> DataFrame:
    """(task, item, base_rank, new_rank): by score, but no item moves more than ``up`` places up or ``down`` down.

    Places are filled from the first: the best of the items that must not sink deeper, if there are any, else the best of
    those that may stand there, else the best of all. Ties go to the lesser item. A task's list is one Pandas group; each
    item enters and leaves two heaps once.
    """
    kind = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        waiting = sorted(zip(group[base_rank].astype(int), -group[score].astype(float), group[item]))
        admitted: list[tuple] = []  # may stand at the place
        due: list[tuple] = []  # would sink too deep behind it
        placed: dict = {}
        seen = [0, 0]
        for place in range(1, len(waiting) + 1):
            for heap, reach, i in ((admitted, place + up, 0), (due, place - down, 1)):
                while seen[i] < len(waiting) and waiting[seen[i]][0] <= reach:
                    heapq.heappush(heap, waiting[seen[i]][1:])
                    seen[i] += 1
                while heap and heap[0][1] in placed:
                    heapq.heappop(heap)
            if not due and not admitted:
                admitted = [x[1:] for x in waiting if x[2] not in placed]
                heapq.heapify(admitted)
                seen[0] = len(waiting)
            placed[(due or admitted)[0][1]] = place
        base = [x[0] for x in waiting]
        items = [x[2] for x in waiting]
        return pd.DataFrame({"task": group[task].iloc[0], "item": items, "base_rank": base, "new_rank": [placed[i] for i in items]})

    result = df.select(task, item, base_rank, score).groupBy(task).applyInPandas(run, f"task {kind[task]}, item {kind[item]}, base_rank int, new_rank int")
    return result.withColumnRenamed("task", task).withColumnRenamed("item", item)


def protect_top(df: DataFrame, task: str, item: str, rank: str, base_rank: str, score: str, k: int = 3, margin: float = 0.2, evidence: str | None = None) -> DataFrame:
    """``df`` with final_rank: items of the base top ``k`` that fell out of the top take their place back, in base order.

    Each of them meets the weakest newcomer still in the top (by score, then item) and changes places with it, unless the
    newcomer's score is at least ``margin`` higher and, where ``evidence`` names a column, that is true for the newcomer.
    At most ``k`` items of a task are on either side, so the walk is a fixed number of column steps in one window.
    """
    w = Window.partitionBy(task)
    enters, leaves = (c(rank) <= k) & (c(base_rank) > k), (c(rank) > k) & (c(base_rank) <= k)
    backed = F.coalesce(c(evidence), F.lit(False)) if evidence else F.lit(True)
    weak = F.array_sort(F.collect_list(F.when(enters, F.struct(c(score).alias("s"), c(item).alias("i"), c(rank).alias("r"), backed.alias("e")))).over(w))
    lost = F.array_sort(F.collect_list(F.when(leaves, F.struct(c(base_rank).alias("b"), c(score).alias("s"), c(rank).alias("r"), c(item).alias("i")))).over(w))
    rows = df.withColumns({"_weak": weak, "_lost": lost, "_at": F.lit(0), "_final": c(rank)})
    for step in range(k):
        mine, other = F.get("_lost", F.lit(step)), F.get("_weak", c("_at"))
        stays = (other["s"] - mine["s"] >= margin) & other["e"]
        swap = F.coalesce(mine.isNotNull() & other.isNotNull() & ~stays, F.lit(False))
        rows = rows.withColumn("_swap", swap)
        rows = rows.withColumn("_final", F.when(c("_swap") & (c(item) == mine["i"]), other["r"]).when(c("_swap") & (c(item) == other["i"]), mine["r"]).otherwise(c("_final")))
        rows = rows.withColumn("_at", c("_at") + c("_swap").cast("int"))
    return rows.withColumn("final_rank", c("_final")).drop("_weak", "_lost", "_at", "_final", "_swap")


def greedy_balanced(df: DataFrame, group: str, item: str, labels: str, n: int, quality: str | None = None) -> DataFrame:
    """(group, item, order, reason): ``n`` items a group that cover its labels evenly.

    Labels are taken from the rarest: one without a chosen item yet gets its best item (``first``), even beyond ``n``. Then
    the label with the least chosen items for the square root of its size gets its best free item (``balance``), and where
    no label has one, the best free items follow (``rest``). Best is by ``quality`` falling, then by item; ties of labels
    by name. Sequential by nature: a group is one Pandas group and must be a bounded catalogue.
    """
    kind = dict(df.dtypes)
    rows = df.select(c(group).alias("g"), c(item).alias("i"), c(labels).alias("l"), (c(quality).cast("double") if quality else F.lit(0.0)).alias("q"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("i").sort_values(["q", "i"], ascending=[False, True], na_position="last")
        of = {i: sorted({x for x in ([] if l is None else l) if x is not None}) for i, l in zip(part["i"], part["l"])}
        members: dict[str, list] = {}
        for i, own in of.items():
            for label in own:
                members.setdefault(label, []).append(i)
        free = {label: iter(m) for label, m in members.items()}
        head = {label: next(f) for label, f in free.items()}
        chosen: dict = {}
        covered = dict.fromkeys(members, 0)

        def best(label: str):  # noqa: ANN202
            while head[label] is not None and head[label] in chosen:
                head[label] = next(free[label], None)
            return head[label]

        def choose(i, reason: str) -> None:  # noqa: ANN001
            chosen[i] = reason
            for label in of[i]:
                covered[label] += 1

        for label in sorted(members, key=lambda x: (len(members[x]), x)):
            if not covered[label]:
                choose(best(label), "first")
        queue = [(covered[x] / math.sqrt(len(members[x])), x) for x in members]
        heapq.heapify(queue)
        while queue and len(chosen) < n:
            load, label = queue[0]
            now = covered[label] / math.sqrt(len(members[label]))
            if best(label) is None:
                heapq.heappop(queue)
            elif now > load:  # a label's load only grows, so an old entry is put back in its place
                heapq.heapreplace(queue, (now, label))
            else:
                choose(best(label), "balance")
        for i in of:
            if len(chosen) >= n:
                break
            if i not in chosen:
                choose(i, "rest")
        return pd.DataFrame({"g": part["g"].iloc[0], "item": list(chosen), "order": range(1, len(chosen) + 1), "reason": list(chosen.values())})

    result = rows.groupBy("g").applyInPandas(run, f"g {kind[group]}, item {kind[item]}, order int, reason string")
    return result.withColumnRenamed("g", group).withColumnRenamed("item", item)


def simplex(step: float, names: Sequence[str]) -> list[dict[str, float]]:
    """All weightings of ``names`` that sum to one, in steps of ``step``."""
    units = round(1 / step)

    def parts(left: int, n: int) -> Iterable[tuple[int, ...]]:
        if n == 1:
            yield (left,)
            return
        for first in range(left + 1):
            for rest in parts(left - first, n - 1):
                yield (first, *rest)

    return [{name: round(v * step, 10) for name, v in zip(names, p)} for p in parts(units, len(names))]
