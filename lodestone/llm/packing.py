"""Filling containers of fixed capacity by vector best-fit.

Every text is a vector (tokens, one document, attention cost = tokens squared) and every container has a capacity in
each dimension. Items go in falling size to the open container that fits in all dimensions and scores best: the
smallest weighted norm of what would stay free, or the largest weighted dot product of item and free room.

Items are hashed into shards of about ``shard_rows`` and each shard is packed on its own, so the work is linear in the
collection and a shard's cost doesn't grow; only the last containers of a shard stay partly empty, a share that falls
as 1 / shard_rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import DEFAULT_VOCABULARY, token_counts

RULES = ("norm", "dot")


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.05)) -> np.ndarray:
    """Container number of each item; ``sizes`` must fall and not exceed ``capacity``.

    An item that alone breaks a secondary capacity gets a container of its own. Ties go to the container opened first.

    Items of one size are placed together. By the norm a container that takes one of them is nearer to full and so stays the
    best for the next, until nothing more fits: the best container takes as many as fit, then the next best. By the dot
    product it is the other way round, so there a run is placed item by item.
    """
    top = np.array([capacity, max_items, max_cost], float)
    scale = np.sqrt(np.array(weights)) / top
    free = np.empty((3, 1024))
    number = np.empty(1024, np.int64)
    live = opened = 0
    where = np.empty(len(sizes), np.int64)
    step = np.ones(len(sizes), bool) if rule == "dot" else np.concatenate(([True], sizes[1:] != sizes[:-1])) if len(sizes) else np.empty(0, bool)
    heads = np.append(np.flatnonzero(step), len(sizes))
    for first, past in zip(heads[:-1].tolist(), heads[1:].tolist()):
        size = float(sizes[first])
        item = np.array([size, 1.0, size * size])
        room = free[:, :live]
        fits = np.flatnonzero((room >= item[:, None]).all(axis=0))
        if len(fits):
            if rule == "norm":
                left = (room[:, fits] - item[:, None]) * scale[:, None]
                fits = fits[np.argsort(np.einsum("ij,ij->j", left, left), kind="stable")]
            else:
                fits = fits[[np.argmax((room[:, fits] * (item * scale * scale)[:, None]).sum(0))]]
            takes = _fitting(room[:, fits], item) if rule == "norm" else np.ones(1, np.int64)
            takes = np.diff(np.minimum(np.concatenate(([0], np.cumsum(takes))), past - first))
            where[first : first + takes.sum()] = np.repeat(number[fits], takes)
            free[:, fits] -= item[:, None] * takes
            first += int(takes.sum())
        each = max(1, int(_fitting(top[:, None], item)[0])) if rule == "norm" else 1
        more = -(-(past - first) // each)
        while live + more > len(number):
            free = np.concatenate((free, np.empty_like(free)), axis=1)
            number = np.concatenate((number, np.empty_like(number)))
        held = np.minimum(each, past - first - each * np.arange(more))
        where[first:past] = opened + np.arange(past - first) // each
        free[:, live : live + more] = top[:, None] - item[:, None] * held
        number[live : live + more] = opened + np.arange(more)
        opened += more
        live += more
        open_ = np.flatnonzero((free[0, :live] > 0) & (free[1, :live] >= 1) & (free[2, :live] > 0)) if size > 0 else np.flatnonzero(free[1, :live] >= 1)
        if len(open_) < live:  # full ones are no longer looked at
            live = len(open_)
            free[:, :live], number[:live] = free[:, open_], number[open_]
    return where


def _fitting(room: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many equal items fit into each room."""
    with np.errstate(divide="ignore"):
        each = np.where(item[:, None] > 0, np.floor(room / item[:, None]), np.inf)
    return each.min(axis=0).astype(np.int64)


#: Default of the attention-cost capacity, as a share of capacity squared, which only one full item alone would reach.
COST_SHARE = 0.875


def pack(
    items: DataFrame, id_col: str, size_col: str, capacity: int = 1024, max_items: int = 128, max_cost: float | None = None, rule: str = "norm", shard_rows: int = 8192, n_rows: int | None = None
) -> DataFrame:
    """(id_col, piece_no int, container_id bigint, start bigint, size bigint): every item in a container.

    Only an item above ``capacity`` is cut: into full pieces, each alone in a container, and a rest that is packed like
    any item. ``start`` is where the piece begins in its item. An item of size null, zero or less is a piece of size 0,
    which takes a document's place in a container but no room. Equal sizes are taken in the order of their ids, so
    the result depends on the rows only, not on their partitioning; a repeated id is packed once per row. An empty
    table gives an empty result. ``max_cost`` is the sum of squared sizes a container may hold, COST_SHARE * capacity squared
    by default: an item of more stands alone. ``n_rows`` spares a count where it is known.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    cost = float(max_cost if max_cost is not None else COST_SHARE * capacity * capacity)
    rows = items.select(F.col(id_col).alias("k"), F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    shards = max(1, math.ceil((items.count() if n_rows is None else n_rows) / shard_rows))
    kind = rows.schema["k"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        group = group.sort_by([("n", "descending"), ("k", "ascending")])
        sizes = group.column("n").to_numpy()
        full = sizes // capacity
        full -= (sizes == full * capacity) & (full > 0)  # the last piece is the rest, of 1 to capacity
        rest = sizes - full * capacity
        order = np.argsort(-rest, kind="stable")
        bins = np.empty(len(sizes), np.int64)
        bins[order] = best_fit(rest[order], capacity, max_items, cost, rule)
        pieces = full + 1
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = number == full[owner]
        container = np.empty(len(owner), np.int64)
        container[last] = bins
        container[~last] = (bins.max() + 1 if len(bins) else 0) + np.arange(int((~last).sum()))
        return pa.table(
            {
                "k": group.column("k").take(pa.array(owner)),
                "piece_no": pa.array(number, pa.int32()),
                "container_id": pa.array(base + container, pa.int64()),
                "start": pa.array(number * capacity, pa.int64()),
                "size": pa.array(np.where(last, rest[owner], capacity), pa.int64()),
            }
        )

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)))
    # shards of a few kilobytes would be merged into few tasks by their size, though each costs a fraction of a second
    packed = sharded.repartition(min(shards, 4096), "shard").groupBy("shard").applyInArrow(run, f"k {kind}, piece_no int, container_id bigint, start bigint, size bigint")
    return packed.withColumnRenamed("k", id_col)


def pack_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, max_items: int = 128, vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None, max_cost: float | None = None
) -> DataFrame:
    """:func:`pack` of texts by their length in tokens; a null or empty text has length 0."""
    sized = token_counts(df, id_col, text_col, vocabulary, folder)
    return pack(sized, id_col, "n_tokens", capacity, max_items, max_cost, n_rows=df.select(id_col).count())
