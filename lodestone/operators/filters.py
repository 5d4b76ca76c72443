"""Hard filters with an audit, three-valued predicates and category conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_match(categories: Column, wanted: Sequence[str], mode: str, children: dict[str, Sequence[str]] | None = None) -> Column:
    """Whether the list holds any, all or none of ``wanted``; a parent stands for itself and its children.

    A null list is unknown and gives null.
    """
    sets = [F.array(*(F.lit(x) for x in dict.fromkeys([w, *(children or {}).get(w, ())]))) for w in wanted]
    hits = [F.arrays_overlap(categories, s) for s in sets]
    hits = [F.when(categories.isNotNull(), F.coalesce(h, F.lit(False))) for h in hits]
    any_of, all_of = hits[0], hits[0]
    for h in hits[1:]:
        any_of, all_of = any_of | h, all_of & h
    return {"any": any_of, "all": all_of, "none": ~any_of}[mode]


def hard_filter(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass every condition, and an audit (step, name, before, after, excluded, unknown).

    A condition that is null is unknown: the row fails it and is counted in both excluded and unknown. All steps are
    counted in one pass: a row is charged to the first condition it fails.
    """
    failed = F.lit(None).cast("int")
    unknown = F.lit(False)
    for i in range(len(steps) - 1, -1, -1):
        condition = steps[i][1]
        passes = F.coalesce(condition, F.lit(False))
        failed = F.when(~passes, F.lit(i + 1)).otherwise(failed)
        unknown = F.when(~passes, condition.isNull()).otherwise(unknown)
    marked = df.withColumn("_failed", failed).withColumn("_unknown", unknown)
    counts = marked.groupBy("_failed").agg(F.count("*").alias("n"), F.count_if("_unknown").alias("u"))
    total = F.sum("n").alias("total")
    names = df.sparkSession.createDataFrame([(i + 1, name) for i, (name, _) in enumerate(steps)], "step int, name string")
    per_step = names.join(F.broadcast(counts.withColumnRenamed("_failed", "step")), "step", "left").select("step", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("excluded"), F.coalesce("u", F.lit(0)).cast("bigint").alias("unknown"))
    everything = counts.agg(total)
    gone = F.sum("excluded").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))  # one row a step
    audit = per_step.withColumn("gone", gone).crossJoin(F.broadcast(everything)).select(
        "step", "name", (F.coalesce("total", F.lit(0)) - F.col("gone") + F.col("excluded")).alias("before"), (F.coalesce("total", F.lit(0)) - F.col("gone")).alias("after"), "excluded", "unknown"
    )
    return marked.where("_failed is null").drop("_failed", "_unknown"), audit


def reason_codes(conditions: Sequence[tuple[str, Column]]) -> Column:
    """The codes of all conditions that hold, in order; null conditions don't."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(code)) for code, condition in conditions)))
