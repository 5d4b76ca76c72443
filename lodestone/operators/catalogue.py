"""Ranking a bounded catalogue for many tasks, each as of its own time.

A task's candidates are ranked among all items of the catalogue, so what it costs is the catalogue, whichever way it is
written. Here it costs one pass of vector arithmetic over the catalogue and no row: tasks and events are cut into slices of
time, the state of the catalogue at the start of a slice (events and stars of each item) is carried into it, and a task of
the cluster walks through its slices in the order of time. Rows come and go in Arrow batches, sorted by Spark, so what a
worker holds is the catalogue and a batch, however many tasks a slice has. Only the chosen candidates become rows.

The catalogue travels to the workers and is checked to be at most CATALOGUE_ROWS items.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import EARTH_KM
from lodestone.sources.workspace import checkpointed

CATALOGUE_ROWS = 1_000_000
#: Events of a slice of time.
SLICE_EVENTS = 200_000
#: Tasks of a slice of time.
SLICE_TASKS = 4_000
#: Rows of a batch that a walk returns, and a task's list more.
OUT_ROWS = 10_000
ROUTES = ("quality", "category", "location", "text")
DIGITS = 9
_c = F.col


@dataclass
class Catalogue:
    """Items in the order of their ids; lists of numbers for their categories and text terms, one after the other."""

    ids: list[str]
    latitude: np.ndarray
    longitude: np.ndarray
    category_of: np.ndarray  # of each (item, category): the item
    category: np.ndarray  # and the category's number
    n_categories: int
    term_of: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n_terms: int


def catalogue(items: DataFrame, weights: DataFrame | None = None, limit: int = CATALOGUE_ROWS) -> Catalogue:
    """``items`` has business_id, latitude, longitude, categories; ``weights`` (business_id, term, weight) are unit text vectors. More than ``limit`` items raise."""
    rows = items.select("business_id", _c("latitude").cast("double"), _c("longitude").cast("double"), "categories").where("business_id is not null").orderBy("business_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a catalogue of more than {limit} items is not ranked whole")
    place = {r[0]: i for i, r in enumerate(rows)}
    names: dict[str, int] = {}
    tags = [(i, names.setdefault(x, len(names))) for i, r in enumerate(rows) for x in sorted({x for x in r[3] or () if x is not None})]
    terms: dict[str, int] = {}
    vectors = [] if weights is None else sorted((place[r[0]], terms.setdefault(r[1], len(terms)), r[2]) for r in weights.collect() if r[0] in place)  # the terms of the catalogue
    number = lambda i: np.array([math.nan if r[i] is None else r[i] for r in rows], float)
    column = lambda table, i, kind: np.array([x[i] for x in table], kind)
    return Catalogue([r[0] for r in rows], number(1), number(2), column(tags, 0, np.int64), column(tags, 1, np.int64), len(names), column(vectors, 0, np.int64), column(vectors, 1, np.int64), column(vectors, 2, float), len(terms))


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """To so many places, halves away from zero as SQL has it."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5) / scale, x)


def exactly(function: np.ufunc, x: np.ndarray) -> np.ndarray:
    """A function of doubles rounded from its extended value: the vector forms of these differ from the C library in the last place."""
    return function(x.astype(np.longdouble)).astype(float)


class Scorer:
    """Scores of all items for one task; NaN where an item has none."""

    def __init__(self, known: Catalogue, prior: float = 20.0, scale_km: float = 10.0):
        self.known, self.prior, self.scale_km = known, prior, scale_km
        self.size = len(known.ids)
        self.cosines = exactly(np.cos, np.radians(known.latitude))
        self.n, self.stars = np.zeros(self.size), np.zeros(self.size)

    def add(self, items: np.ndarray, n: np.ndarray, stars: np.ndarray) -> None:
        """Counts events of the past."""
        np.add.at(self.n, items, n)
        np.add.at(self.stars, items, stars)

    def quality(self) -> np.ndarray:
        """0.8 of the Bayesian mean rating on 0..1 and 0.2 of log(1 + events) capped at the catalogue's 95th percentile."""
        seen = self.n > 0
        out = np.full(self.size, math.nan)
        if seen.any():
            n, stars, many = self.n[seen], self.stars[seen], np.log1p(self.n[seen])
            p95 = np.percentile(many, 95)
            rating = np.clip(((stars + self.prior * (stars.sum() / n.sum())) / (n + self.prior) - 1) / 4, 0, 1)
            out[seen] = rounded(0.8 * rating + 0.2 * (np.minimum(many, p95) / p95 if p95 > 0 else 0.0))
        return out

    def category(self, items: np.ndarray, n: np.ndarray, stars: np.ndarray) -> np.ndarray:
        """The best category of an item by 0.7 mean stars and 0.3 frequency in the history; items of none of its categories have none."""
        k = self.known
        times, sums = np.zeros(self.size), np.zeros(self.size)
        times[items], sums[items] = n, stars
        seen, total = np.bincount(k.category, times[k.category_of], k.n_categories), np.bincount(k.category, sums[k.category_of], k.n_categories)
        out = np.full(self.size, -math.inf)
        if seen.any():
            held = seen > 0
            score = np.full(k.n_categories, -math.inf)
            score[held] = 0.7 * ((total[held] / seen[held] - 1) / 4) + 0.3 * seen[held] / seen.max()
            np.maximum.at(out, k.category_of, score[k.category])
        return np.where(np.isfinite(out), rounded(out), math.nan)

    def distance(self, items: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Kilometres from the mean place of the history's events, which is taken to six decimals: a sum of floats in no fixed order has not all of them."""
        lat, lon = self.known.latitude, self.known.longitude
        placed = ~(np.isnan(lat[items]) | np.isnan(lon[items]))
        if not placed.any():
            return np.full(self.size, math.nan)
        a, b = (float(rounded(np.float64(math.fsum((x[items] * n)[placed]) / n[placed].sum()), 6)) for x in (lat, lon))
        half = exactly(np.sin, np.radians(lat - a) / 2) ** 2 + math.cos(math.radians(a)) * self.cosines * exactly(np.sin, np.radians(lon - b) / 2) ** 2
        return 2 * EARTH_KM * exactly(np.arcsin, np.sqrt(np.clip(half, 0, 1)))

    def text(self, items: np.ndarray, liked: np.ndarray, disliked: np.ndarray) -> np.ndarray:
        """0.5 + 0.5 cosine to what was liked - 0.5 cosine to what was not, in 0..1, of items with a text; none without a signed history."""
        k = self.known
        sides = []
        for sign in (liked, disliked):
            times = np.zeros(self.size)
            times[items] = sign
            centre = np.bincount(k.term, times[k.term_of] * k.weight, k.n_terms)
            norm = math.sqrt(float(centre @ centre))
            sides.append(np.bincount(k.term_of, centre[k.term] * k.weight, self.size) / norm if norm > 0 else None)
        if sides[0] is None and sides[1] is None:
            return np.full(self.size, math.nan)
        good, bad = (np.zeros(self.size) if x is None else x for x in sides)
        out = np.full(self.size, math.nan)
        described = np.unique(k.term_of)
        out[described] = rounded(np.clip(0.5 + 0.5 * good - 0.5 * bad, 0, 1))[described]
        return out


def ranked(score: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` items by falling score, then id; items with a NaN have no place."""
    have = np.flatnonzero(~np.isnan(score))
    if 0 < n < len(have):
        have = have[score[have] >= np.partition(score[have], len(have) - n)[len(have) - n]]  # all that tie with the n-th
    return have[np.lexsort((have, -score[have]))[:n]]


@dataclass
class _Walk:
    """What a walk ranks: lists by name and length (ROUTES or ``fused``), scores of all items besides, and the fusion."""

    known: Catalogue
    lists: dict[str, int]
    shown: tuple[str, ...]
    weights: dict[str, float]
    per_route: int
    constant: float

    def __post_init__(self) -> None:
        self.fused = self.weights if "fused" in self.lists else {}
        self.routes = {r: max(self.lists.get(r, 0), self.per_route if r in self.fused else 0) for r in ROUTES if r in self.lists or r in self.fused}
        self.scored = {*self.routes, *self.shown}

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Task]:
        ids, scorer, slice_, quality = pa.array(self.known.ids, pa.string()), None, None, None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            places = lambda x: pc.fill_null(pc.index_in(x, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            where, tasks = places(column["business_id"]), column["task_id"].is_valid().to_numpy(zero_copy_only=False)
            n, stars = (column[x].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for x in ("n", "s"))
            slices = column["slice"].to_numpy(zero_copy_only=False)
            starts, entries = _runs(column["history"])
            own = places(entries.field("business_id"))
            own_n, own_s, liked, disliked = (entries.field(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in ("n", "s", "liked", "disliked"))
            asked_starts, asked = _runs(column["wanted"])
            asked = places(asked)
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(batch)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if slices[low] != slice_:
                    scorer, slice_, quality = Scorer(self.known), slices[low], None
                done = low
                for row in [*(low + np.flatnonzero(tasks[low:high])).tolist(), high]:
                    events = done + np.flatnonzero(where[done:row] >= 0)
                    if len(events):
                        scorer.add(where[events], n[events], stars[events])
                        quality = None
                    done = row + 1
                    if row == high:
                        break
                    if quality is None and "quality" in self.scored:
                        quality = scorer.quality()
                    mine = slice(starts[row], starts[row + 1])
                    in_it = own[mine] >= 0
                    history = (own[mine][in_it], *(x[mine][in_it] for x in (own_n, own_s, liked, disliked)))
                    yield self._task(batch, row, scorer, quality, history, asked[asked_starts[row] : asked_starts[row + 1]])

    def _task(self, batch: pa.RecordBatch, row: int, scorer: Scorer, quality: np.ndarray | None, history: tuple[np.ndarray, ...], wanted: np.ndarray) -> _Task:
        items, many, sums, liked, disliked = history
        none = np.full(scorer.size, math.nan)
        scores = {}
        if "quality" in self.scored:
            scores["quality"] = quality
        if "category" in self.scored:
            scores["category"] = scorer.category(items, many, sums)
        if "location" in self.scored:
            scores["km"] = scorer.distance(items, many) if len(items) else none
            scores["location"] = rounded(exactly(np.exp, -scores["km"] / scorer.scale_km))
        if "text" in self.scored:
            scores["text"] = scorer.text(items, liked, disliked) if self.known.n_terms else none
        listed = {}
        for route in self.routes:
            listed[route] = scores[route]
            if route == "quality":
                listed[route] = quality.copy()
                listed[route][items] = math.nan
            elif route == "category":
                listed[route] = np.where(scores[route] > 0, scores[route], math.nan)
        chosen = {route: ranked(listed[route], length) for route, length in self.routes.items()}
        count = np.zeros(scorer.size, np.int64)
        if self.fused:
            total = np.full(scorer.size, math.nan)
            for route, weight in self.fused.items():
                first = chosen[route][: self.per_route]
                count[first] += 1
                total[first] = np.nan_to_num(total[first]) + weight / (self.constant + np.arange(1, len(first) + 1))
            listed["fused"] = rounded(total)
            chosen["fused"] = ranked(listed["fused"], self.lists["fused"])
        else:
            for first in chosen.values():
                count[first] += 1
        return _Task(batch, row, items, wanted[wanted >= 0], {name: chosen[name][:length] for name, length in self.lists.items()}, listed, scores, count)


@dataclass
class _Task:
    batch: pa.RecordBatch
    row: int
    own: np.ndarray  # items of the history
    wanted: np.ndarray
    chosen: dict[str, np.ndarray]  # items of each list, in its order
    listed: dict[str, np.ndarray]  # scores the lists go by
    scores: dict[str, np.ndarray]  # uncut scores
    count: np.ndarray  # lists of routes an item is in

    @property
    def name(self) -> str:
        return self.batch.column(self.batch.schema.get_field_index("task_id"))[self.row].as_py()


def _runs(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the list of each row begins and the last ends, and all entries; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten()


def _stream(events: DataFrame, tasks: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """Rows of events, of the state before each slice, and of tasks (with history and the items ``wanted`` of it), by slice and in the order of time; a task stands before the events of its time."""
    spark = events.sparkSession
    events = checkpointed(events.select("user_id", "business_id", "stars", "t"))
    past = tasks.select("task_id", "user_id", "cutoff_time").where("task_id is not null and user_id is not null and cutoff_time is not null")
    own = past.join(events.select("user_id", "business_id", "stars", "t"), "user_id").where("t < cutoff_time").groupBy("task_id", "business_id")
    own = own.agg(F.count("*").alias("n"), F.sum("stars").alias("s"), F.count_if(_c("stars") >= 4).alias("liked"), F.count_if(_c("stars") <= 2).alias("disliked"))
    history = own.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("business_id", "n", "s", "liked", "disliked"))).alias("history"))  # at most an entry an item
    asked = past.select("task_id", _c("cutoff_time").alias("at")).join(history, "task_id", "left")
    if wanted is None:
        asked = asked.withColumn("wanted", F.lit(None).cast("array<string>"))
    else:
        asked = asked.join(wanted.groupBy("task_id").agg(F.collect_set("business_id").alias("wanted")), "task_id", "left")

    slices = max(spark.sparkContext.defaultParallelism, math.ceil(events.count() / SLICE_EVENTS), math.ceil(past.count() / SLICE_TASKS))
    cuts = checkpointed(past.agg(F.array_sort(F.array_distinct(F.percentile_approx("cutoff_time", [i / slices for i in range(1, slices)] or [0.5], 10_000))).alias("cuts")))  # one row
    cut = lambda df, time: df.crossJoin(F.broadcast(cuts)).withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda x: x <= _c(time))), F.lit(0))).drop("cuts")
    placed = cut(events.select("business_id", "stars", _c("t").alias("at")), "at")
    ends = placed.groupBy("slice", "business_id").agg(F.count("*").alias("n"), F.sum("stars").alias("s"))
    # the state before each slice: an entry a slice and item, summed over the slices before it
    w = Window.partitionBy("business_id").orderBy("slice")
    upto = ends.select("slice", "business_id", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.lead("slice").over(w).alias("next"))
    last = cuts.select(F.size("cuts").alias("last"))
    until = F.coalesce("next", "last")
    before = upto.crossJoin(F.broadcast(last)).where(until > _c("slice")).select("business_id", "n", "s", F.explode(F.sequence(_c("slice") + 1, until)).alias("slice"))
    state = placed.select("slice", "business_id", "at", F.lit(1).cast("bigint").alias("n"), _c("stars").alias("s")).unionByName(before.select("slice", "business_id", F.lit(None).cast("timestamp_ntz").alias("at"), "n", "s"))
    rows = state.unionByName(cut(asked, "at"), allowMissingColumns=True)
    return rows.repartition(slices, "slice").sortWithinPartitions("slice", _c("at").asc_nulls_first(), _c("task_id").isNull(), "task_id").select("slice", "business_id", "n", "s", "task_id", "history", "wanted")


def _batches(rows: Iterator[tuple[int, dict]], schema: str, make: Callable[[str, list], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches of about OUT_ROWS rows of parts (number of rows, the part of each column)."""
    names = [x.split()[0] for x in schema.split(", ")]
    parts, size = [], 0
    for n, part in rows:
        parts.append(part)
        size += n
        if size >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([make(name, [p[name] for p in parts]) for name in names], names)
            parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([make(name, [p[name] for p in parts]) for name in names], names)


def candidates(
    events: DataFrame, tasks: DataFrame, known: Catalogue, by: str, n: int, per_route: int = 500, weights: dict[str, float] | None = None, constant: float = 60.0,
    shown: Sequence[str] = ROUTES, also: dict[str, int] | None = None, wanted: DataFrame | None = None, head: int = 0,
) -> DataFrame:
    """(task_id, business_id, score, rank, route_count, seen, quality, category, location, text, km): the first ``n`` items of each task.

    ``by`` is one of ROUTES, or ``fused`` for the sum of weight / (``constant`` + rank) over the first ``per_route`` of the
    routes in ``weights``. score and rank are those of ``by``; the other columns are the item's uncut scores of the routes in
    ``shown``, null where it has none, route_count is the number of routes that list it, and seen tells whether the task's
    own history has it. ``also`` lists more routes with their lengths: their items have rows too, with a null rank where
    ``by`` does not list them, and a column of each route, such as quality_rank. With ``wanted`` (task_id, business_id) only the
    listed items in it and the first ``head`` of ``by`` become rows. ``events`` has user_id, business_id, stars, t and counts
    strictly before a task's cutoff_time; ``tasks`` has task_id, user_id, cutoff_time. The quality route leaves out items of
    the task's own history, and the category route those that score 0 or less. Ties go to the lesser id. Tasks of a null
    id, user or time have no row.
    """
    also, some = dict(also or {}), wanted is not None
    shared = events.sparkSession.sparkContext.broadcast(known)
    numbers = [f"{r}_rank" for r in also]
    schema = ", ".join(["task_id string", "business_id string", "score double", "rank int", "route_count int", "seen boolean", *(f"{x} double" for x in (*ROUTES, "km")), *(f"{x} int" for x in numbers)])
    walk = lambda: _Walk(shared.value, {by: n} | {r: k for r, k in also.items() if r != by}, tuple(shown), dict(weights or {}), per_route, constant)

    def rows(task: _Task) -> tuple[int, dict]:
        best, size = task.chosen[by], len(task.count)
        rank = {}
        for column, items in (("rank", best), *((f"{r}_rank", task.chosen[r][:k]) for r, k in also.items())):
            rank[column] = np.zeros(size, np.int32)
            rank[column][items] = np.arange(1, len(items) + 1)
        if some:
            items = np.union1d(task.wanted, best[:head])
            items = items[np.any([r[items] > 0 for r in rank.values()], axis=0)]
        else:
            items = np.concatenate([best, *(task.chosen[r][:k][rank["rank"][task.chosen[r][:k]] == 0] for r, k in also.items())]) if also else best
            if len(also) > 1:
                items = items[np.sort(np.unique(items, return_index=True)[1])]
        part = {"task_id": (task.name, len(items)), "business_id": items, "score": np.where(rank["rank"][items] > 0, task.listed[by][items], math.nan), "route_count": task.count[items], "seen": np.isin(items, task.own)}
        part |= {x: task.scores[x][items] if x in task.scores else np.full(len(items), math.nan) for x in (*ROUTES, "km")}
        return len(items), part | {x: r[items] for x, r in rank.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(shared.value.ids, pa.string())

        def make(name: str, parts: list) -> pa.Array:
            if name == "task_id":
                return pa.array([x for x, _ in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [k for _, k in parts])))
            values = np.concatenate(parts)
            if name == "business_id":
                return ids.take(pa.array(values.astype(np.int64)))
            if values.dtype == float:
                return pa.array(values, pa.float64(), from_pandas=True)
            return pa.array(values) if name == "seen" else pa.array(values.astype(np.int32), mask=values == 0 if name.endswith("rank") else None)

        yield from _batches(map(rows, walk().over(batches)), schema, make)

    return _stream(events, tasks, wanted).mapInArrow(run, schema)


def negatives(
    events: DataFrame, tasks: DataFrame, known: Catalogue, targets: DataFrame, n_hard: int, n_similar: int, n_random: int, per_route: int, weights: dict[str, float], take: Sequence[int] = (10, 5, 5), seed: str = "negative", constant: float = 60.0
) -> DataFrame:
    """(task_id, business_id, negative_kind, selection_order): items of each task that are not among its ``targets`` (task_id, business_id).

    ``hard`` are the first of the fused list, ``similar`` the first of the category route, ``random`` those of the quality
    route by a hash; each leaves out what the kinds before it took. The lists are ``n_hard``, ``n_similar`` and ``n_random``
    long. A task chooses where it is ranked, so its lists don't become rows.
    """
    shared = events.sparkSession.sparkContext.broadcast(known)
    schema = "task_id string, business_id string, negative_kind string, selection_order int"

    def rows(task: _Task) -> tuple[int, dict]:
        name, ids = task.name, shared.value.ids
        free = np.ones(len(ids), bool)
        free[task.wanted] = False
        kinds = []
        for kind, route, k in zip(("hard", "similar", "random"), ("fused", "category", "quality"), take):
            items = task.chosen[route][free[task.chosen[route]]]
            if kind == "random":
                items = sorted(items.tolist(), key=lambda i: hashlib.sha256(f"{seed}:{name}:{ids[i]}".encode()).hexdigest())
            items = np.asarray(items[:k], np.int64)
            free[items] = False
            kinds += [(ids[item], kind, i + 1) for i, item in enumerate(items.tolist())]
        return len(kinds), {"task_id": [name] * len(kinds), **{x: [k[i] for k in kinds] for i, x in enumerate(("business_id", "negative_kind", "selection_order"))}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(shared.value, {"fused": n_hard, "category": n_similar, "quality": n_random}, (), weights, per_route, constant)
        make = lambda name, parts: pa.array([x for p in parts for x in p], pa.int32() if name == "selection_order" else pa.string())
        yield from _batches(map(rows, walk.over(batches)), schema, make)

    return _stream(events, tasks, targets).mapInArrow(run, schema)


def text_weights(items: DataFrame, text: str, stop_words: Sequence[str] = (), min_df: int = 2) -> DataFrame:
    """(business_id, term, weight): TF-IDF of runs of one and two words of a column, rows of unit length.

    Sublinear term frequency, idf = ln((1 + n) / (1 + df)) + 1, terms of at least ``min_df`` items; ``stop_words`` are left
    out before words are paired. An item without such a term has no row.
    """
    words = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words
    docs = items.where(_c(text).isNotNull()).select("business_id", kept.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    counted = docs.select("business_id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("business_id", "term").agg(F.count("*").alias("f"))
    df = counted.groupBy("term").agg(F.count("*").alias("df")).where(_c("df") >= min_df)
    n = docs.agg(F.count("*").alias("n"))  # one row
    raw = counted.join(df, "term").crossJoin(F.broadcast(n)).select("business_id", "term", ((1 + F.log("f")) * (F.log((1 + _c("n")) / (1 + _c("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(_c("w") * _c("w")).over(Window.partitionBy("business_id")))
    return raw.select("business_id", "term", (_c("w") / norm).alias("weight"))
