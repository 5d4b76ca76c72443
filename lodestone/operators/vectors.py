"""Exact vector search of a query set against all rows, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def _unit(column: pa.ChunkedArray, size: int) -> np.ndarray:
    parts = [np.empty((0, size))]
    for lists in column.chunks:
        offsets = lists.offsets.to_numpy()
        parts.append(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(-1, size))
    flat = np.concatenate(parts)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


def cosine_top(queries: DataFrame, base: DataFrame, id_col: str, vector_col: str, k: int, size: int, block: int = 2_000, part: int = 100_000) -> DataFrame:
    """(query_id, id, cosine, rank): the ``k`` nearest other rows of each query by cosine, ties to the lesser id; exact.

    Query blocks meet data parts pairwise, each pair one matrix product; parts send k rows a query. Rows whose vector is
    null, of another size, or holds nulls, NaN or infinity take no part.
    """
    fine = c(vector_col).isNotNull() & (F.size(vector_col) == size) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = queries.where(fine).select(c(id_col).cast("bigint").alias("query_id"), c(vector_col).cast("array<double>").alias("qv"))
    x = base.where(fine).select(c(id_col).cast("bigint").alias("id"), c(vector_col).cast("array<double>").alias("v"))
    blocks, parts = max(1, math.ceil(q.count() / block)), max(1, math.ceil(x.count() / part))
    q = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    x = x.withColumn("xp", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            ids, qs = right.column("id").to_numpy(), left.column("query_id").to_numpy()
            scores = _unit(left.column("qv"), size) @ _unit(right.column("v"), size).T
            scores[qs[:, None] == ids[None, :]] = -np.inf
            scores = np.round(scores, 9)
            order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
            top = np.take_along_axis(scores, order, axis=1)
            keep = top > -np.inf
            out = [np.repeat(qs, keep.sum(axis=1)), ids[order][keep], top[keep]]
        empty = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(v, t) for v, t in zip(out or [[], [], []], empty)], names=["query_id", "id", "cosine"])

    found = q.groupBy("b", "p").cogroup(x.groupBy("xb", "xp")).applyInArrow(run, "query_id bigint, id bigint, cosine double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(c("cosine").desc(), "id"))).where(c("rank") <= k)
