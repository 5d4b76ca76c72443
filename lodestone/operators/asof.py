"""As-of joins: each event with the attributes valid and known at its time.

A version is available from the later of its validity and its recording. Among the versions available at a time the one
with the latest validity counts, then the latest recording, then the greatest id; so an entity's current state is a
running maximum over availability. Entities are hashed into buckets; a bucket's events meet its state timeline in an
embedded DuckDB ASOF LEFT JOIN. An entity of more rows than a task should have (one may hold a third of them) stands apart
from the buckets and is cut into time slices at its own quantiles, as many as its own size asks for, and the state that
holds at the start of a slice is carried into it as one row. So neither events nor versions of a hot entity ever gather in
one task, and no other entity is touched by it.
"""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import micros
from lodestone.sources.workspace import checkpointed

#: Rows (events and versions) of one bucket or slice.
TASK_ROWS = 200_000
#: Quantiles of a hot entity's times, from which its cuts are taken; beyond CUTS * TASK_ROWS rows its slices grow.
CUTS = 999

_ASOF = """
with timeline as (
    select entity, avail, max(best) over (partition by entity order by avail range between unbounded preceding and current row) as best
    from (select entity, avail, max({'valid_from': valid_from, 'recorded': recorded, 'id': id}) as best from versions group by entity, avail)
)
select e.event_id, e.entity, e.t, s.best.id as attribute_id, s.best.valid_from as valid_from
from events e asof left join timeline s on e.entity = s.entity and e.t >= s.avail
"""


def _joined(events: pa.Table, versions: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1}) as con:
        con.register("events", events)
        con.register("versions", versions)
        result = con.sql(_ASOF).to_arrow_table()
    return result.cast(pa.schema([("event_id", pa.string()), ("entity", pa.string()), ("t", pa.timestamp("us")), ("attribute_id", pa.string()), ("valid_from", pa.timestamp("us"))]))


def as_known(events: DataFrame, versions: DataFrame) -> DataFrame:
    """(event_id, entity, t, attribute_id, valid_from): every event with the version valid and recorded at its time.

    ``events`` has event_id, entity string and t timestamp; ``versions`` has id, entity string and valid_from, recorded
    timestamp; other columns are not read. Times are compared as given, without zones; equal times count as known.
    An event without such a version, of a null entity or a null time, comes out with null attributes. Versions with a
    null entity, id, validity or recording never count. Repeated events come out once, repeated versions have no
    effect; empty tables on either side are allowed.
    """
    c, spark = F.col, events.sparkSession
    e = checkpointed(events.select(c("event_id").cast("string"), c("entity").cast("string"), c("t").cast("timestamp_ntz")).distinct())
    v = versions.select(c("id").cast("string"), c("entity").cast("string"), c("valid_from").cast("timestamp_ntz"), c("recorded").cast("timestamp_ntz"))
    v = v.where("id is not null and entity is not null and valid_from is not null and recorded is not null").distinct().withColumn("avail", F.greatest("valid_from", "recorded"))
    v = checkpointed(v)
    known, unknown = e.where("entity is not null and t is not null"), e.where("entity is null or t is null")

    times = known.select("entity", c("t").alias("at")).union(v.select("entity", c("avail").alias("at")))
    # one count an entity, combined on the map side; of these a row for each hot entity, at most rows / TASK_ROWS, and one for the rest
    counts = times.groupBy("entity").count()
    sizes = counts.groupBy(F.when(c("count") > 2 * TASK_ROWS, c("entity")).alias("hot_entity")).agg(F.sum("count").alias("k")).collect()
    buckets = max(1, math.ceil(sum(r["k"] for r in sizes if r["hot_entity"] is None) / TASK_ROWS))
    slices = {r["hot_entity"]: math.ceil(r["k"] / TASK_ROWS) for r in sizes if r["hot_entity"] is not None}
    bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("string")
    if not slices:
        left, right = (df.withColumn("bucket", bucket).withColumn("slice", F.lit(0)) for df in (known, v))
    else:
        hot = spark.createDataFrame(list(slices.items()), "hot_entity string, parts int")  # broadcast by Spark while it is small
        cuts = times.join(hot, c("entity") == c("hot_entity")).groupBy("hot_entity").agg(F.first("parts").alias("parts"), F.percentile_approx("at", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias("all"))
        # of the fine quantiles as many as the entity has parts; where it asks for more all of them
        wanted = F.when(c("parts") > CUTS, c("all")).otherwise(F.transform(F.sequence(F.lit(1), c("parts") - 1), lambda i: F.element_at("all", F.round(i * (CUTS + 1) / c("parts")).cast("int"))))
        cuts = checkpointed(cuts.select("hot_entity", F.array_sort(F.array_distinct(wanted)).alias("cuts")))

        def sliced(df: DataFrame, time: str) -> DataFrame:
            place = F.coalesce(F.size(F.filter("cuts", lambda x: x <= c(time))), F.lit(0))
            where = F.when(c("hot_entity").isNotNull(), F.concat(F.lit("="), c("entity"))).otherwise(bucket)
            return df.join(cuts, c("entity") == c("hot_entity"), "left").withColumn("bucket", where).withColumn("slice", place).drop("cuts", "hot_entity")

        left, by_slice = sliced(known, "t"), sliced(v, "avail")
        # the state at the end of each slice of a hot entity; its running maximum goes into the slice after it
        ends = by_slice.join(hot, c("entity") == c("hot_entity"), "left_semi").groupBy("entity", "slice").agg(F.max(F.struct("valid_from", "recorded", "id")).alias("s"))
        every = cuts.select(c("hot_entity").alias("entity"), F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice"))
        earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # slices, not rows
        carried = every.join(ends, ["entity", "slice"], "left").withColumn("s", F.max("s").over(earlier)).where("s is not null")
        carried = carried.select("s.id", "entity", "s.valid_from", "s.recorded", F.greatest("s.valid_from", "s.recorded").alias("avail"), F.concat(F.lit("="), c("entity")).alias("bucket"), "slice")
        right = by_slice.unionByName(carried)

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        return _joined(a.select(["event_id", "entity", "t"]), b.select(["id", "entity", "valid_from", "recorded", "avail"]))

    left = left.select(*(c(n).alias(n) for n in ("event_id", "entity", "t", "bucket", "slice")))
    right = right.select("id", c("entity").alias("entity"), "valid_from", "recorded", "avail", c("bucket").alias("v_bucket"), c("slice").alias("v_slice"))
    matched = left.groupBy("bucket", "slice").cogroup(right.groupBy("v_bucket", "v_slice")).applyInArrow(join, "event_id string, entity string, t timestamp_ntz, attribute_id string, valid_from timestamp_ntz")
    return matched.union(unknown.select("event_id", "entity", "t", F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")))


def before(order: str, *keys: str) -> Window:
    """Window of the rows of ``keys`` strictly before the current one's time: peers at the same time are left out."""
    return Window.partitionBy(*keys).orderBy(micros(F.col(order))).rangeBetween(Window.unboundedPreceding, -1)


def latest_at_or_before(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, fact_id: str, strict: bool = False, slices: int = 128) -> DataFrame:
    """``probes`` with ``fact_id`` and ``fact_time`` of the newest fact of the key at or before (``strict``: before) the probe's time.

    Facts of one time are resolved to the greatest id. Time is cut into ``slices`` of equal length: the newest fact of a key's
    earlier slices is found from one row a slice, and only the probe's own slice is run through a window, partitioned by key
    and slice, so a key that holds most facts is spread over its slices. A probe costs one sorted row, never a range join.
    Null keys and times never match; a probe without a fact keeps nulls.
    """
    c = F.col
    order = 0 if strict else 2  # where a probe sorts beside facts of the same time, which are at 1
    f = facts.where(c(key).isNotNull() & c(fact_time).isNotNull()).groupBy(c(key).alias("_k"), c(fact_time).alias("_t")).agg(F.max(fact_id).alias("_id"))
    p = probes.select(c(key).alias("_k"), c(probe_time).alias("_t"), F.struct(*probes.columns).alias("_row"))
    span = f.agg(F.min(micros(c("_t"))).alias("_lo"), F.max(micros(c("_t"))).alias("_hi"))  # one row

    def sliced(df: DataFrame) -> DataFrame:
        place = F.floor((micros(c("_t")) - c("_lo")) / (F.floor((c("_hi") - c("_lo")) / slices) + 1))
        return df.crossJoin(F.broadcast(span)).withColumn("_s", F.coalesce(F.greatest(F.lit(-1), F.least(F.lit(slices), place)), F.lit(0)).cast("int")).drop("_lo", "_hi")

    f, p = sliced(f), sliced(p)
    fact = F.struct(c("_t").alias("t"), c("_id").alias("id"))
    marks = f.groupBy("_k", "_s").agg(F.max(fact).alias("_fact")).unionByName(p.select("_k", "_s").distinct().withColumn("_fact", F.lit(None).cast(f.select(fact.alias("x")).schema["x"].dataType)))
    marks = marks.groupBy("_k", "_s").agg(F.max("_fact").alias("_fact"))
    earlier = marks.select(c("_k").alias("_mk"), c("_s").alias("_ms"), F.max("_fact").over(Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # slices, not facts
    none = p.schema["_row"].dataType
    rows = p.select("_k", "_s", "_t", F.lit(order).alias("_o"), "_row", F.lit(None).cast(f.select(fact.alias("x")).schema["x"].dataType).alias("_fact")).unionByName(f.select("_k", "_s", "_t", F.lit(1).alias("_o"), F.lit(None).cast(none).alias("_row"), fact.alias("_fact")))
    so_far = Window.partitionBy("_k", "_s").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_last", F.last("_fact", ignorenulls=True).over(so_far)).where(c("_o") == order)
    both = seen.join(earlier, (c("_k") == c("_mk")) & (c("_s") == c("_ms")), "left")
    found = F.when(c("_k").isNotNull() & c("_t").isNotNull(), F.coalesce("_last", "_before"))
    return both.select("_row.*", found["id"].alias(fact_id), found["t"].alias(fact_time))
