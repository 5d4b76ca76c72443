"""The k most similar vectors of every vector, by collision counting over single projections.

1. Directions are fitted on a bounded sample. Every vector is entered under the ENTRIES directions it has the greatest
   projections on, and searches the one it has the very greatest on. A list of a direction holds about LIST_ROWS vectors,
   however many there are in all: one sorted array over the whole collection would put a share of it, not a number, into
   every window, and the work would grow with its square.
2. A list keeps sorted arrays of its vectors' values on PROJECTIONS single projections. A query opens a window around its own
   value in each array and counts, for every vector, in how many windows it lies. Vectors that collide in NEED windows or
   more are verified by their exact cosine. If k verified vectors are not yet as near as the windows are made for, all
   windows widen (virtual rehashing: the arrays stay, only the ends move) and the search goes on. Where even the widest
   windows verify fewer than k vectors, and only there, a query is compared with its whole list.
3. Every query ends in one task, with its copies, so no candidate is shuffled.

Lists are bounded in rows: a larger one is split and its queries visit each part. Equal vectors are one entry, however many
they are. The work is the number of vectors times a constant up to MAX_LISTS * LIST_ROWS / ENTRIES vectors; beyond that lists
grow, are split, and each query visits more parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed

ENTRIES = 4
LIST_ROWS = 768
MAX_PART_ROWS = 6144
MAX_LISTS = 16_384
#: Vectors at most that directions are fitted on (the lowest hashes of their ids).
SAMPLE_ROWS = 131_072
PROJECTIONS = 16
NEED = 11
#: Distances of unit vectors that the windows are made for, and the half-width of a window in standard deviations of a
#: projected difference of that length.
RADII = (0.25, 0.4, 0.6, 0.9)
HALF_WIDTH = 1.5
#: Copies of one vector from which they are reduced to their least ids before they are entered.
HOT_COPIES = 64


def usable(vector: Column, size: int) -> Column:
    """Of ``size`` finite entries that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & F.coalesce(~bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors as rows, in double precision."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [np.empty((0, size))]
    for chunk in chunks:
        offsets = chunk.offsets.to_numpy()
        rows.append(chunk.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64).reshape(-1, size))
    return np.concatenate(rows)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow for huge, no underflow for tiny entries
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_directions(sample: np.ndarray, wanted: int, rounds: int = 3) -> np.ndarray:
    """Spherical k-means of the sample, started on its first rows, so that dense places get many directions."""
    found = sample[:wanted].copy()
    for _ in range(rounds):
        sums = np.zeros_like(found)
        for at in range(0, len(sample), 4096):
            part = sample[at : at + 4096]
            np.add.at(sums, (part @ found.T).argmax(axis=1), part)
        norm = np.linalg.norm(sums, axis=1)
        found[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return found


class SortedArrays:
    """The vectors of a list on its single projections: sorted values, and each vector's rank among them.

    Projections are the principal axes of the list, on which it is spread most.
    """

    def __init__(self, rows: np.ndarray):
        m = min(PROJECTIONS, rows.shape[1])
        middle = rows - rows.mean(axis=0)
        self.axes = np.linalg.eigh(middle.T @ middle)[1][:, -m:]
        self.at = rows @ self.axes
        order = np.argsort(self.at, axis=0, kind="stable")
        self.values = np.take_along_axis(self.at, order, axis=0)
        self.rank = np.empty((m, len(rows)), np.uint32)
        np.put_along_axis(self.rank, order.T, np.arange(len(rows), dtype=np.uint32)[None, :], axis=1)

    def collisions(self, at: np.ndarray, half: float) -> np.ndarray:
        """(queries, vectors): in how many windows of half-width ``half`` around the queries' values a vector lies.

        A window is a run of ranks, so a vector lies in it if its rank does.
        """
        counts = np.zeros((len(at), self.rank.shape[1]), np.uint8)
        for values, rank, mine in zip(self.values.T, self.rank, at.T):
            low = np.searchsorted(values, mine - half).astype(np.uint32)
            size = np.searchsorted(values, mine + half, side="right").astype(np.uint32) - low
            counts += (rank[None, :] - low[:, None]) < size[:, None]  # unsigned: a rank below the window is a huge difference
        return counts


def search_list(base: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, chunk: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, cosine) of at most ``k`` other vectors for each query, and how many pairs were verified.

    ``own`` is the query's row in ``base``, or -1.
    """
    n = len(base)
    arrays = SortedArrays(base)
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    verified = 0
    step = HALF_WIDTH / math.sqrt(base.shape[1])
    need = math.ceil(NEED * arrays.rank.shape[0] / PROJECTIONS)
    for first in range(0, len(queries), chunk):
        q, mine = queries[first : first + chunk], own[first : first + chunk]
        at = q @ arrays.axes
        left = np.arange(len(q))
        possible = n - (mine >= 0)
        for radius in (*RADII, None):
            if not len(left):
                break
            if radius is None:  # fewer than k even in the widest windows
                r, c = (x.reshape(-1) for x in np.broadcast_arrays(np.arange(len(left))[:, None], np.arange(n)[None, :]))
            else:
                r, c = np.nonzero(arrays.collisions(at[left], step * radius) >= need)
            other = c != mine[left][r]
            r, c = r[other], c[other]
            cosine = np.einsum("ij,ij->i", q[left][r], base[c])
            verified += len(r)
            order = np.lexsort((-cosine, r))
            r, c, cosine = r[order], c[order], cosine[order]
            held = np.bincount(r, minlength=len(left))
            starts = np.cumsum(held) - held
            enough = held >= np.minimum(k, possible[left])
            done = enough.copy()
            if radius is not None and radius != RADII[-1]:
                kth = np.full(len(left), -1.0)
                full = held >= k
                kth[full] = cosine[starts[full] + k - 1]
                done &= (kth >= 1 - radius * radius / 2) | (held == possible[left])  # the cosine of that distance
            place = np.arange(len(r)) - starts[r]
            # ties at the k-th place stay in, the ids decide later
            last = np.where(held >= k, cosine[np.minimum(starts + k - 1, max(len(cosine) - 1, 0))] if len(cosine) else -1.0, -2.0)
            kept = done[r] & ((place < k) | (cosine >= last[r] - 1e-12))
            for column, values in zip(out, (first + left[r[kept]], c[kept], cosine[kept])):
                column.append(values)
            left = left[~done]
    return *(np.concatenate(x) for x in out), verified


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` numbers from each start, one run after the other."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def nearest_ids(raw: np.ndarray, ids: list[list[int]], is_base: np.ndarray, is_query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, cosine, rank) of the ids of the query rows among the base rows of one list.

    Rows with equal vectors become one class; a class offers its k + 1 least ids, which is all that any answer can hold.
    """
    _, first, of = np.unique(np.ascontiguousarray(raw.astype(np.float32)).view(np.dtype((np.void, 4 * raw.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
    of = of.reshape(-1)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, owner = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum())), np.repeat(of, lengths)

    def held(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (class, id) of some rows, by class and id."""
        pick = np.repeat(rows, lengths)
        both = np.unique(np.stack((owner[pick], flat[pick])), axis=1) if pick.any() else np.empty((2, 0), np.int64)
        return both[0], both[1]

    base_class, base_id = held(is_base)
    sizes = np.bincount(base_class, minlength=len(first))
    starts = np.cumsum(sizes) - sizes
    offered = np.minimum(sizes, k + 1)
    in_base = np.flatnonzero(sizes)
    query_class, query_id = held(is_query)
    asked = np.unique(query_class)
    place = np.full(len(first), -1)
    place[in_base] = np.arange(len(in_base))
    vectors = unit(raw[first])
    q, c, cosine, _ = search_list(vectors[in_base], vectors[asked], place[asked], k)
    # the classes near each query's class, itself included, and of these the ids
    near_of = np.concatenate((asked[q], asked[place[asked] >= 0]))
    near = np.concatenate((in_base[c], asked[place[asked] >= 0]))
    score = np.concatenate((cosine, np.ones(int((place[asked] >= 0).sum()))))
    order = np.argsort(near_of, kind="stable")
    near_of, near, score = near_of[order], near[order], score[order]
    begin, end = np.searchsorted(near_of, query_class), np.searchsorted(near_of, query_class, side="right")
    which = _expand(begin, end - begin)
    sought = np.repeat(query_id, end - begin)
    many = offered[near[which]]
    neighbour = base_id[_expand(starts[near[which]], many)]
    sought, score = np.repeat(sought, many), np.repeat(score[which], many)
    other = sought != neighbour
    sought, neighbour, score = sought[other], neighbour[other], score[other]
    order = np.lexsort((neighbour, -score, sought))
    sought, neighbour, score = sought[order], neighbour[order], score[order]
    _, begin = np.unique(sought, return_index=True)
    rank = np.arange(len(sought)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(sought)])))) + 1
    top = rank <= k
    return sought[top], neighbour[top], score[top], rank[top]


_FOUND = "id bigint, neighbour bigint, cosine double, rank int"


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 5, size: int = 64) -> DataFrame:
    """(id, neighbour, cosine, rank) of the ``k`` most similar vectors of every usable vector; ids are bigint.

    Ties go to the lesser id. Usable vectors have ``size`` finite entries that are not all zero; others, and null ids,
    take no part. Repeated rows of one id count once; if they differ the least vector stands. Fewer than k + 1 usable
    vectors give what there is; an empty table gives an empty result. Extra columns are not read. Approximate: recall
    against brute force is measured in the tests and the README.
    """
    spark, c = df.sparkSession, F.col
    points = df.select(c(id_col).cast("bigint").alias("id"), c(vector_col).cast("array<float>").alias("vector")).where(c("id").isNotNull() & usable(c("vector"), size))
    points = checkpointed(points.groupBy("id").agg(F.min("vector").alias("vector")))
    same = F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit(1), "vector").alias("y")).alias("same")
    copies = checkpointed(points.select(same).groupBy("same").count().groupBy(F.when(c("count") > HOT_COPIES, c("same")).alias("same")).agg(F.sum("count").alias("n")))
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = copies.where("same is not null")  # at most rows / HOT_COPIES
    if hot.isEmpty():
        base, rest = points.select("id", "vector", F.array("id").alias("ids")), None
    else:
        marked = points.select("id", "vector", same).join(hot.select("same", F.lit(True).alias("hot")), "same", "left")
        spread = Window.partitionBy("same", F.pmod("id", F.lit(64))).orderBy("id")
        least = marked.where("hot").select("same", "id").withColumn("r", F.row_number().over(spread)).where(c("r") <= k + 1)
        least = checkpointed(least.groupBy("same").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))  # at most 64 * (k + 1) ids
        first = points.join(least.select(F.element_at("ids", 1).alias("id"), "ids"), "id")
        base = marked.where("hot is null").select("id", "vector", F.array("id").alias("ids")).union(first.select("id", "vector", "ids"))
        rest = marked.where("hot").select("same", "id").join(least, "same").where(c("id") > F.element_at("ids", -1))
    wanted = min(MAX_LISTS, max(1, round(total * ENTRIES / LIST_ROWS)))
    sample = points.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(min(SAMPLE_ROWS, max(64 * wanted, 1024))).select("vector").toArrow()
    rows = _matrix(sample.column("vector"), size)
    directions = fit_directions(unit(rows), wanted).astype(np.float32) if len(rows) else np.zeros((1, size), np.float32)
    entries = min(ENTRIES, len(directions))
    shared = spark.sparkContext.broadcast(directions)  # at most MAX_LISTS rows

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                near = unit(_matrix(part.column(1), size)).astype(np.float32) @ shared.value.T
                top = np.argpartition(-near, entries - 1, axis=1)[:, :entries]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable"), axis=1)
                row = pa.array(np.repeat(np.arange(len(part)), entries))
                home = pa.array(np.tile(np.arange(entries) == 0, len(part)))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(3)), pa.array(top.reshape(-1), pa.int32()), home], ["id", "vector", "ids", "list", "home"])

    entered = base.mapInArrow(enter, "id bigint, vector array<float>, ids array<bigint>, list int, home boolean")
    # a row a list, MAX_LISTS at most
    sizes = {r["list"]: r["n"] for r in entered.groupBy("list").agg(F.count("*").alias("n")).where(c("n") > MAX_PART_ROWS).collect()} if total > MAX_PART_ROWS else {}
    entered = entered.withColumns({"part": F.lit(0), "is_base": F.lit(True)})
    if sizes:
        split = spark.createDataFrame([(cell, math.ceil(n / MAX_PART_ROWS)) for cell, n in sizes.items()], "list int, parts int")
        own = F.pmod(F.xxhash64("vector"), F.coalesce("parts", F.lit(1))).cast("int")
        parts = F.when(c("home"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array("own"))
        entered = entered.join(F.broadcast(split), "list", "left").withColumn("own", own).withColumn("part", F.explode(parts)).withColumn("is_base", c("part") == c("own"))

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        flags = [table.column(name).to_numpy() for name in ("is_base", "home")]
        found = nearest_ids(_matrix(table.column("vector"), size), ids, *flags, k) if flags[1].any() else [np.empty(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("id", "neighbour", "cosine", "rank"), found, kinds)})

    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total * ENTRIES / (32 * LIST_ROWS)))
    found = entered.select("list", "part", "vector", "ids", "is_base", "home").repartition(tasks, "list", "part").groupBy("list", "part").applyInArrow(search, _FOUND)
    by_score = Window.partitionBy("id").orderBy(c("cosine").desc(), "neighbour")
    if sizes:  # a query that visited several parts has k of each
        found = found.withColumn("rank", F.row_number().over(by_score)).where(c("rank") <= k)
    if rest is not None:
        others = rest.select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine"))
        found = found.union(others.withColumn("rank", F.row_number().over(by_score)))
    return found
