"""Ordered folds: patches, preferences and tool updates become one state."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import micros

c = F.col


def latest_per_pair(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key: a new one replaces what the old one contributed. Null keys are a key of their own."""
    fields = [n for n in events.columns if n not in keys and n not in order]
    return events.groupBy(*keys).agg(F.max(F.struct(*order, *fields)).alias("x")).select(*keys, "x.*")


#: Patches below it have no effect.
MIN_CONFIDENCE = 0.6


def fold_patches(patches: Iterable[dict], min_confidence: float = MIN_CONFIDENCE) -> dict[str, dict]:
    """Conditions after the patches in order: add, replace and remove by slot.

    A patch under ``min_confidence``, or whose evidence text is empty, has no effect. A hard condition is only removed
    by a patch that says so explicitly, and only a hard patch replaces it.
    """
    state: dict[str, dict] = {}
    for p in patches:
        if (p.get("confidence") or 0.0) < min_confidence or not p.get("evidence"):
            continue
        slot, held = p["slot"], state.get(p["slot"])
        if p["operation"] == "remove":
            if held and (not held["hard"] or p.get("explicit")):
                del state[slot]
        elif p["operation"] == "replace" or held is None:
            if held is None or not held["hard"] or p.get("hard"):
                state[slot] = {"value": p.get("value"), "hard": bool(p.get("hard"))}
    return state


#: What a slot may hold before a patch, by which the effect of a run of patches is told.
_STARTS = ("none", "soft", "hard")


def _effect(patches: Iterable[dict]) -> dict[str, dict | None | str]:
    """What a run of patches of one slot makes of each start: ``same``, None or a state. Effects of runs can be composed."""
    out: dict[str, dict | None | str] = {}
    for start in _STARTS:
        held: dict | None = None if start == "none" else {"hard": start == "hard", "same": True}
        for p in patches:
            if (p.get("confidence") or 0.0) < MIN_CONFIDENCE or not p.get("evidence"):
                continue
            if p["operation"] == "remove":
                if held and (not held["hard"] or p.get("explicit")):
                    held = None
            elif p["operation"] == "replace" or held is None:
                if held is None or not held["hard"] or p.get("hard"):
                    held = {"value": p.get("value"), "hard": bool(p.get("hard"))}
        out[start] = "same" if held and held.get("same") else held
    return out


def _composed(effects: Iterable[dict]) -> dict | None:
    """The state after runs of patches, one after the other, from nothing."""
    state: dict | None = None
    for effect in effects:
        result = effect["none" if state is None else "hard" if state["hard"] else "soft"]
        state = state if result == "same" else result
    return state


def fold_sessions(df: DataFrame, session: str, turn: str, patch: str, slices: int = 64) -> DataFrame:
    """(session, slot, value, hard, n_patches): the conditions of each session after its patches (JSON text) in the order of turns.

    Slots don't touch each other, and what a run of patches does to one is a small table from what the slot held before. So
    the patches of a session, slot and slice of time become such a table first, and the tables of a slot, at most ``slices``,
    are applied one after the other: a session of any length is spread over its slots and slices. ``turn`` is a zone-less
    time; patches of one turn are taken in the order of their text. value is JSON text. A slot without a condition at the end
    has no row; null patches, sessions and turns are left out.
    """
    kind = dict(df.dtypes)[session]
    rows = df.where(c(patch).isNotNull() & c(session).isNotNull() & c(turn).isNotNull()).select(c(session).alias("s"), micros(c(turn)).alias("at"), c(patch).alias("p")).withColumn("slot", F.get_json_object("p", "$.slot")).where("slot is not null")
    span = rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))  # one row
    cut = rows.crossJoin(F.broadcast(span)).withColumn("slice", F.floor((c("at") - c("lo")) / (F.floor((c("hi") - c("lo")) / slices) + 1)).cast("int")).drop("lo", "hi")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [json.dumps(_effect([json.loads(x["p"]) for x in patches])) for patches in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in batch.column(3)], pa.int64()), pa.array(done, pa.string())], ["s", "slot", "slice", "n", "effect"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [_composed(json.loads(x["effect"]) for x in runs) for runs in batch.column(3).to_pylist()]
            value, hard = [None if x is None else json.dumps(x["value"]) for x in states], [None if x is None else x["hard"] for x in states]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(value, pa.string()), pa.array(hard, pa.bool_()), batch.column(2)], ["s", "slot", "value", "hard", "n"]).filter(pa.array([x is not None for x in states]))

    lists = cut.groupBy("s", "slot", "slice").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("run"))  # the patches of a slot in a slice
    tables = lists.mapInArrow(effects, f"s {kind}, slot string, slice int, n bigint, effect string")
    runs = tables.groupBy("s", "slot").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("slice", "effect"))).alias("runs"))  # ``slices`` entries
    done = runs.mapInArrow(finish, f"s {kind}, slot string, value string, hard boolean, n bigint")
    return done.withColumnRenamed("s", session).withColumnRenamed("n", "n_patches")


def preference_fold(df: DataFrame, keys: list[str], slot: str, value: str, priority: str, order: str) -> DataFrame:
    """``df`` with status: per slot the first by priority is active; an equal value is supporting; another value of the same priority is suppressed, of a lower one shadowed."""
    w = Window.partitionBy(*keys, slot).orderBy(c(priority), c(order))
    first_value, first_priority = F.first(value).over(w), F.first(priority).over(w)
    status = F.when(F.row_number().over(w) == 1, "active").when(c(value).eqNullSafe(first_value), "supporting").when(c(priority) == first_priority, "suppressed").otherwise("shadowed")
    return df.withColumn("status", status)
