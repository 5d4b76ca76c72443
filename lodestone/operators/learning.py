"""Pairwise logistic ranking and plug-in scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed

FORBIDDEN = ("label", "target", "outcome")


def pairwise_logistic(pairs: DataFrame, features: Sequence[str], l2: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Weights w that order positive over negative: ``pairs`` hold feature differences, positive minus negative.

    Differences are scaled by their root mean square; the symmetric loss needs no intercept. Each Newton step is one
    distributed aggregate of the gradient and Hessian, whose size depends on the number of features only.
    """
    m = len(features)
    rows = checkpointed(pairs.select(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features))))
    if rows.isEmpty():
        return np.zeros(m)
    scale = np.sqrt(np.array(rows.agg(*(F.avg(F.col(f"x{i}") ** 2) for i in range(m))).first(), float))
    scale[scale == 0] = 1.0
    w = np.zeros(m)

    def gather(current: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(m + m * m)
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy() for i in range(m)]) / scale
                p = 1 / (1 + np.exp(np.clip(x @ current, -35, 35)))
                total[:m] += x.T @ p
                total[m:] += ((x * (p * (1 - p))[:, None]).T @ x).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # m + m * m rows
        return np.array([r["v"] for r in got])

    for _ in range(rounds):
        sums = gather(w)
        gradient, hessian = sums[:m] - l2 * w, sums[m:].reshape(m, m) + l2 * np.eye(m)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def linear(weights: Sequence[float]) -> Callable[[np.ndarray, Sequence[str]], np.ndarray]:
    return lambda matrix, names: matrix @ np.asarray(weights)


def batch_score(df: DataFrame, keys: Sequence[str], features: Sequence[str], scorer: Callable[[np.ndarray, Sequence[str]], np.ndarray]) -> DataFrame:
    """``keys`` and score: a plug-in ``scorer(matrix, names)`` applied to Arrow batches; label columns are refused."""
    if leaked := [f for f in features if f.lower() in FORBIDDEN]:
        raise ValueError(f"features hold labels: {leaked}")
    rows = df.select(*keys, *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", score double"
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.column_stack([batch.column(k + i).to_numpy() for i in range(len(features))]) if len(batch) else np.empty((0, len(features)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(np.asarray(scorer(matrix, features), float))], [*keys, "score"])

    return rows.mapInArrow(run, schema)


def score_pairs(df: DataFrame, keys: Sequence[str], left: str, right: str, scorer: Callable[[list, list], list]) -> DataFrame:
    """``keys`` and score: a plug-in ``scorer(left values, right values) -> numbers or None`` applied to Arrow batches of pairs."""
    rows = df.select(*keys, F.col(left).alias("_left"), F.col(right).alias("_right"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", score double"
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(scores, pa.float64())], [*keys, "score"])

    return rows.mapInArrow(run, schema)
