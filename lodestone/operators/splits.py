"""Leak-free task splits over user histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalars import hash_order

c = F.col


def positions(events: DataFrame) -> DataFrame:
    """``events`` (user_id, review_id, t, ...) with pos from 1 by (t, review_id), n, and the time of the event before."""
    w = Window.partitionBy("user_id").orderBy("t", "review_id")
    return events.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).withColumn("previous_t", F.lag("t").over(w))


def leave_last_two_out(events: DataFrame, min_events: int = 3) -> DataFrame:
    """(user_id, split, review_id, business_id, cutoff_time, history_count, history_max_time, tie): two tasks a user.

    The last event is the test target, the one before it validation; the cutoff is the target's time. ``tie`` marks a
    target at the same time as its history, which a caller must reject.
    """
    p = positions(events).where(c("n") >= min_events).where("pos >= n - 1")
    return p.select(
        "user_id", F.when(c("pos") == c("n"), "test").otherwise("validation").alias("split"), "review_id", "business_id", c("t").alias("cutoff_time"),
        (c("pos") - 1).cast("bigint").alias("history_count"), c("previous_t").alias("history_max_time"), (c("previous_t") == c("t")).alias("tie"),
    )


def rolling_targets(events: DataFrame, min_history: int = 8, reserve: int = 2, limit: int = 6) -> DataFrame:
    """(user_id, review_id, target_position from 0, k from 1, n_targets, sample_weight): training targets of each user.

    A position is safe when its time is strictly after the one before and it has ``min_history`` events and the reserved
    tail stays free. Of each run of neighbouring safe positions every second is taken, from the first (a gap of two),
    the last is moved to the last safe position, and of more than ``limit`` an evenly spaced choice that keeps both
    ends remains. Weights rise linearly from 0.5 to 1. Everything is a window over the user's positions.
    """
    user = Window.partitionBy("user_id")
    safe = positions(events).where(c("pos") - 1 >= min_history).where(c("pos") <= c("n") - reserve).where("previous_t < t").withColumn("p", c("pos") - 1)
    runs = safe.withColumn("run", c("p") - F.row_number().over(user.orderBy("p")))
    taken = runs.withColumn("first", F.min("p").over(Window.partitionBy("user_id", "run"))).withColumn("last", F.max("p").over(user))
    taken = taken.withColumn("spaced", (c("p") - c("first")) % 2 == 0)
    # the last spaced position gives way to the last safe one
    taken = taken.withColumn("last_spaced", F.max(F.when(c("spaced"), c("p"))).over(user))
    taken = taken.where((c("spaced") & (c("p") != c("last_spaced"))) | (c("p") == c("last")))
    ranked = taken.withColumn("i", F.row_number().over(user.orderBy("p")) - 1).withColumn("m", F.count("*").over(user))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda j: F.bround(j * (c("m") - 1) / F.lit(float(limit - 1)), 0))
    kept = ranked.where((c("m") <= limit) | F.array_contains(chosen, c("i").cast("double")))
    k = F.row_number().over(user.orderBy("p"))
    size = F.count("*").over(user)
    weight = F.when(size == 1, F.lit(1.0)).otherwise(0.5 + 0.5 * (k - 1) / F.nullif(size - 1, F.lit(0)))
    return kept.select("user_id", "review_id", c("p").cast("bigint").alias("target_position"), k.alias("k"), size.alias("n_targets"), F.round(weight, 9).alias("sample_weight"))


def grouped_split(rows: DataFrame, group: str, stratum: str, shares: dict[str, float], trials: int = 16, seed: str = "split") -> DataFrame:
    """(group, part, deviation): groups put whole into parts, by the trial that keeps the strata most alike.

    In every trial a hash of seed, trial and group decides the part. A trial's deviation is the sum, over parts and strata, of
    the difference between a stratum's share in the part and in all rows; the least wins, then the first. Only counts by
    group and stratum are tried, not the rows.
    """
    c = F.col
    counts = rows.groupBy(c(group).alias("g"), c(stratum).alias("s")).agg(F.count("*").alias("n"))
    u = F.conv(F.substring(hash_order(seed, c("trial").cast("string"), c("g")), 1, 8), 16, 10).cast("double") / 2**32
    names, upto, part = list(shares), 0.0, None
    for name in names[:-1]:
        upto = round(upto + shares[name], 12)
        part = F.when(u < upto, name) if part is None else part.when(u < upto, name)
    tried = counts.select("g").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("part", part.otherwise(names[-1]) if part is not None else F.lit(names[-1]))
    cells = tried.join(counts, "g").groupBy("trial", "part", "s").agg(F.sum("n").alias("n"))  # trials x parts x strata
    sizes = cells.groupBy("trial", "part").agg(F.sum("n").alias("t"))
    share = counts.groupBy("s").agg(F.sum("n").alias("k")).withColumn("share", c("k") / F.sum("k").over(Window.partitionBy()))  # a row a stratum
    off = sizes.crossJoin(F.broadcast(share)).join(cells, ["trial", "part", "s"], "left").withColumn("d", F.abs(F.coalesce("n", F.lit(0)) / c("t") - c("share")))
    best = off.groupBy("trial").agg(F.round(F.sum("d"), 9).alias("deviation")).orderBy("deviation", "trial").limit(1)
    return tried.join(F.broadcast(best), "trial").select(c("g").alias(group), "part", "deviation")
