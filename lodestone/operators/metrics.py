"""Ranking, classification and calibration metrics, and their uncertainty."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def target_ranks(tasks: DataFrame, ranking: DataFrame, task: str, item: str) -> DataFrame:
    """``tasks`` (task, target, ...) with the target's rank, null where the ranking lacks it."""
    hit = ranking.select(task, c(item).alias("target"), c("rank").cast("bigint").alias("target_rank"))
    return tasks.join(hit, [task, "target"], "left")


def single_positive(rank: Column, cutoffs: Sequence[int] = (1, 3, 5)) -> dict[str, Column]:
    """Aggregates of HR@k, MRR and NDCG@5 over tasks with one relevant item; a missing rank scores 0."""
    hit = lambda k: F.when(rank <= k, 1.0).otherwise(0.0)
    out = {f"hr_{k}": F.round(F.avg(hit(k)), 9) for k in cutoffs}
    out["mrr"] = F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 9)
    out["ndcg_5"] = F.round(F.avg(F.when(rank <= 5, 1 / F.log2(rank + 1)).otherwise(0.0)), 9)
    return out


def with_status(numerator: Column, denominator: Column) -> Column:
    """(status, value): measured, or not_applicable for a denominator of 0, or unavailable for a null one."""
    status = F.when(denominator.isNull() | numerator.isNull(), "unavailable").when(denominator == 0, "not_applicable").otherwise("measured")
    return F.struct(status.alias("status"), F.round(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), 9).alias("value"))


def multi_relevant(ranking: DataFrame, relevant: DataFrame, task: str, item: str, k: int = 5) -> DataFrame:
    """(task, hits, mrr, ndcg) over tasks with several relevant items; the ideal gain counts min(k, relevant) items."""
    hits = ranking.join(relevant.select(task, item).distinct(), [task, item]).groupBy(task).agg(
        F.count_if(c("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(c("rank") <= k, 1 / F.log2(c("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    total = relevant.select(task, item).distinct().groupBy(task).agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(c("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    return total.join(hits, task, "left").select(task, F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce(1 / c("first"), F.lit(0.0)), 9).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 9).alias("ndcg"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) from one confusion matrix; absent denominators give 0."""
    m = confusion(df, truth, predicted)
    sides = m.select(F.explode(F.array(F.struct(c(truth).alias("label"), c("n").alias("t"), F.lit(0).cast("bigint").alias("p")), F.struct(c(predicted).alias("label"), F.lit(0).cast("bigint").alias("t"), c("n").alias("p")))).alias("x"), F.when(c(truth) == c(predicted), c("n")).otherwise(0).alias("hit"))
    g = sides.groupBy(c("x.label").alias("label")).agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("said"), (F.sum("hit") / 2).alias("hit"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return g.select("label", "support", F.round(ratio(c("hit"), c("said")), 9).alias("precision"), F.round(ratio(c("hit"), c("support")), 9).alias("recall"), F.round(ratio(2 * c("hit"), c("support") + c("said")), 9).alias("f1"))


def _placed(df: DataFrame, probability: str, order: Sequence[str], down: bool = False, ranges: int = 1024) -> DataFrame:
    """``df`` with i, its place from 0 in the order of ``probability`` (falling with ``down``), then ``order``, and n, the number of rows.

    Rows are counted by range of probability first, and then placed within their range, so no task sorts them all.
    """
    ranged = df.withColumn("_range", F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor(c(probability) * ranges))).cast("int"))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("k"))  # at most ``ranges`` rows
    way = c("_range").desc() if down else c("_range").asc()
    before = sizes.select("_range", (F.sum("k").over(Window.orderBy(way).rowsBetween(Window.unboundedPreceding, 0)) - c("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("_range").orderBy(c(probability).desc() if down else c(probability).asc(), *order)
    return ranged.join(F.broadcast(before), "_range").withColumn("i", c("before") + F.row_number().over(inside) - 1).drop("before", "_range")


def calibration(df: DataFrame, probability: str, outcome: str, order: Sequence[str], bins: int = 10) -> DataFrame:
    """One row: n, Brier score, and expected calibration error over ``bins`` bins of equal size in the order of probability, then ``order``."""
    ranked = _placed(df, probability, order)
    small, extra = F.floor(c("n") / bins), c("n") % bins  # the first ``extra`` bins have one row more
    head = extra * (small + 1)
    bin_ = F.when(c("i") < head, F.floor(c("i") / (small + 1))).otherwise(extra + F.floor((c("i") - head) / F.nullif(small, F.lit(0))))
    per = ranked.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.avg(probability).alias("p"), F.avg(c(outcome).cast("double")).alias("o"), F.sum(F.pow(c(probability) - c(outcome).cast("double"), 2)).alias("se"))
    return per.agg(F.sum("k").alias("n"), F.round(F.sum("se") / F.sum("k"), 9).alias("brier"), F.round(F.sum(c("k") * F.abs(c("p") - c("o"))) / F.sum("k"), 9).alias("ece"))


def coverage_risk(df: DataFrame, probability: str, outcome: str, order: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(coverage, n, risk): the share of wrong outcomes among the most probable ``coverage`` of the rows."""
    marked = _placed(df, probability, order, down=True).withColumn("coverage", F.explode(F.array(*(F.lit(float(p)) for p in points)))).where(c("i") + 1 <= F.ceil(c("coverage") * c("n")))
    return marked.groupBy("coverage").agg(F.count("*").alias("n"), F.round(1 - F.avg(c(outcome).cast("double")), 9).alias("risk"))


#: Distribution of a Poisson variable of mean 1, by which a uniform number becomes a count.
POISSON = tuple(float(x) for x in np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]))
_PRIME, _STRIDE = 2_147_483_647, 2_654_435_761


def paired_bootstrap(df: DataFrame, unit: str, left: str, right: str, rounds: int = 500, seed: str = "boot") -> DataFrame:
    """One row: mean difference left - right, its 95 % interval and the share of resamples above 0, resampling units.

    Rows are summed per unit first. A unit's count in a resample is Poisson(1), drawn from a cubic of the unit's hash, shifted
    by the resample and taken modulo a prime, so a resample is a sum that merges over partitions and no unit list is gathered.
    """
    number = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), c(unit).cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(_PRIME))
    per = df.groupBy(unit).agg(F.sum(c(left) - c(right)).alias("d"), F.count("*").alias("n")).select(number.alias("h"), "d", "n")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n = np.zeros(rounds), np.zeros(rounds)
        shift = np.arange(rounds, dtype=np.int64) * _STRIDE % _PRIME
        for batch in batches:
            for at in range(0, len(batch), 512):
                h, diff, size = (batch.column(i).to_numpy()[at : at + 512] for i in range(3))
                z = (h[:, None] + shift) % _PRIME
                u = z * z % _PRIME * z % _PRIME / _PRIME
                times = np.searchsorted(POISSON, u, side="right")
                d += diff @ times
                n += size @ times
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds), pa.int32()), pa.array(d), pa.array(n)], ["b", "d", "n"])

    sums = per.mapInArrow(draw, "b int, d double, n double").groupBy("b").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0.0))).alias("delta"))
    mean = per.agg(F.round(F.sum("d") / F.sum("n"), 9).alias("delta"))
    return sums.agg(F.round(F.percentile("delta", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("delta", F.lit(0.975)), 9).alias("high"), F.round(F.avg((c("delta") > 0).cast("double")), 9).alias("share_above_zero")).crossJoin(mean)


def logistic_calibrator(df: DataFrame, score: str, outcome: str, l2: float = 1e-6, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a + b * score))) that fits 0/1 outcomes best; each Newton step is one aggregate of six sums."""
    rows = df.where(c(score).isNotNull() & c(outcome).isNotNull()).select(c(score).cast("double").alias("x"), c(outcome).cast("double").alias("y"))
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * c("x"))))
        v = p * (1 - p)
        g0, g1, h0, h1, h2 = rows.agg(F.sum(c("y") - p), F.sum((c("y") - p) * c("x")), F.sum(v), F.sum(v * c("x")), F.sum(v * c("x") * c("x"))).first()
        if g0 is None:
            return 0.0, 0.0
        step = np.linalg.solve(np.array([[h0 + l2, h1], [h1, h2 + l2]]), np.array([g0 - l2 * a, g1 - l2 * b]))
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return a, b


def isotonic(df: DataFrame, score: str, outcome: str, most: int = 100_000) -> DataFrame:
    """(score, fitted): the non-decreasing means of a 0/1 outcome by score that are nearest to it.

    Rows are counted by score first; scores are to be binned to at most ``most`` values, which is checked. Neighbouring
    scores out of order are pooled until none is left.
    """
    counts = df.where(c(score).isNotNull() & c(outcome).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"), F.sum(c(outcome).cast("double")).alias("_s")).orderBy(score).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} scores: bin them first")
    pools: list[list[float]] = []  # rows, sum of outcomes, scores
    for row in counts:
        pools.append([row["_n"], row["_s"], 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, s, k = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + s, pools[-1][2] + k]
    fitted = [s / n for n, s, k in pools for _ in range(int(k))]
    kind = dict(df.dtypes)[score]
    return df.sparkSession.createDataFrame([(row[score], f) for row, f in zip(counts, fitted)], f"{score} {kind}, fitted double")
