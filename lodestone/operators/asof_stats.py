"""Running aggregates as of a time, over keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import micros


def totals_before(facts: DataFrame, probes: DataFrame, keys: list[str], time: str, measures: list[str], slices: int = 128) -> DataFrame:
    """``probes`` (keys, time) with ``n`` and the sum of each measure over the key's facts strictly before the time.

    The facts' time is cut into ``slices`` of equal length. A key's totals of whole slices are summed first (they combine
    on the map side); only the part of a slice before the probe is run through a window, partitioned by key and slice,
    so a key that holds most facts is spread over its slices. Probes of equal key and time come out as often as they
    come in; a key without facts has 0. Null keys and times are left out.
    """
    c = F.col
    f = facts.select(*keys, micros(c(time)).alias("at"), *(c(m).cast("double").alias(m) for m in measures)).dropna(subset=[*keys, "at"])
    p = probes.select(*keys, micros(c(time)).alias("at"), F.struct(*probes.columns).alias("probe")).dropna(subset=[*keys, "at"])
    span = f.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))  # one row
    width = F.greatest(F.lit(1), F.floor((c("hi") - c("lo")) / slices) + 1)

    def sliced(df: DataFrame) -> DataFrame:
        place = F.greatest(F.lit(-1), F.least(F.lit(slices), F.floor((c("at") - c("lo")) / width)))
        return df.crossJoin(F.broadcast(span)).withColumn("slice", F.coalesce(place, F.lit(0)).cast("int")).drop("lo", "hi")

    f, p = sliced(f), sliced(p)
    zero = [F.lit(0.0).alias(m) for m in measures]
    whole = f.groupBy(*keys, "slice").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in measures))
    marks = whole.select(*keys, "slice", F.lit(1).alias("is_fact"), "n", *measures).union(p.select(*keys, "slice").distinct().select(*keys, "slice", F.lit(0).alias("is_fact"), F.lit(0).cast("bigint"), *zero))
    earlier = Window.partitionBy(*keys).orderBy("slice", "is_fact").rowsBetween(Window.unboundedPreceding, -1)  # slices, not facts
    carried = marks.select(*keys, "slice", "is_fact", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), *(F.coalesce(F.sum(m).over(earlier), F.lit(0.0)).alias(f"{m}0") for m in measures)).where("is_fact = 0").drop("is_fact")
    none = p.select(F.lit(None).cast(p.schema["probe"].dataType).alias("probe")).schema["probe"].dataType
    rows = f.select(*keys, "slice", "at", F.lit(1).alias("is_fact"), F.lit(None).cast(none).alias("probe"), *measures).union(p.select(*keys, "slice", "at", F.lit(0).alias("is_fact"), "probe", *zero))
    inside = Window.partitionBy(*keys, "slice").orderBy("at", "is_fact").rowsBetween(Window.unboundedPreceding, 0)  # probes sort before facts of their time
    part = rows.select(*keys, "slice", "is_fact", "probe", F.sum("is_fact").over(inside).alias("n1"), *(F.sum(m).over(inside).alias(f"{m}1") for m in measures)).where("is_fact = 0")
    total = part.join(carried, [*keys, "slice"])
    return total.select("probe.*", (c("n0") + c("n1")).alias("n"), *((c(f"{m}0") + c(f"{m}1")).alias(m) for m in measures))
