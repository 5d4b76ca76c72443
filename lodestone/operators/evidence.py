"""Decayed signals, aspect summaries and evidence aggregation as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S

c = F.col


def _saturation(mass: Column, at: float) -> Column:
    return 1 - F.exp(-mass / at)


def decayed_signal(rows: DataFrame, keys: list[str], half_life_days: float = 365.0, saturation: float = 3.0) -> DataFrame:
    """Per key of ``rows`` (keys, direction, confidence, event_time, cutoff_time): score, confidence, evidence and its span.

    The score is the mean direction weighted by age and source confidence; confidence rises with the mass and with how
    one-sided it is.
    """
    w = S.half_life_weight(S.age_days(c("event_time"), c("cutoff_time")), half_life_days) * c("confidence")
    g = rows.withColumn("w", w).groupBy(*keys).agg(
        F.sum(c("w") * c("direction")).alias("s"), F.sum("w").alias("mass"), F.count("*").alias("evidence_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_confirmed")
    )
    score = c("s") / F.nullif(c("mass"), F.lit(0.0))
    return g.select(
        *keys, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 9).alias("score"), F.round(_saturation(c("mass"), saturation) * (0.5 + 0.5 * F.abs(score)), 9).alias("confidence"),
        "evidence_count", F.round("mass", 9).alias("effective_evidence"), "first_seen", "last_confirmed",
    )


def aspect_summary(rows: DataFrame, keys: list[str], half_life_days: float = 365.0, min_evidence: int = 3, min_users: int = 2, saturation: float = 3.0, user_saturation: float = 3.0, conflict: float = 0.35) -> DataFrame:
    """Per key of ``rows`` (keys, user_id, sentiment, confidence, event_time, cutoff_time): counts, decayed ratios, confidence and conflict.

    Known needs enough directional (positive or negative) evidence from enough users; otherwise the ratios are null,
    confidence is 0 and there is no conflict.
    """
    w = S.half_life_weight(S.age_days(c("event_time"), c("cutoff_time")), half_life_days) * c("confidence")
    n = lambda s: F.count_if(c("sentiment") == s)
    mass = lambda s: F.coalesce(F.sum(F.when(c("sentiment") == s, c("w"))), F.lit(0.0))
    g = rows.withColumn("w", w).groupBy(*keys).agg(
        n("positive").alias("positive_count"), n("negative").alias("negative_count"), n("neutral").alias("neutral_count"), n("mixed").alias("mixed_count"), F.count("*").alias("evidence_count"),
        F.countDistinct("user_id").alias("unique_users"), F.countDistinct(F.when(c("sentiment").isin("positive", "negative"), c("user_id"))).alias("du"), mass("positive").alias("wp"), mass("negative").alias("wn"), F.sum("w").alias("mass"), F.max("event_time").alias("latest"),
    )
    dw = c("wp") + c("wn")
    known = (c("positive_count") + c("negative_count") >= min_evidence) & (c("du") >= min_users) & (dw > 0)
    share_p, share_n = c("wp") / F.nullif(dw, F.lit(0.0)), c("wn") / F.nullif(dw, F.lit(0.0))
    confidence = _saturation(dw, saturation) * (0.5 + 0.25 * _saturation(c("du"), user_saturation) + 0.25 * F.greatest(share_p, share_n))
    return g.select(
        *keys, F.when(known, "known").otherwise("unknown").alias("status"), "positive_count", "negative_count", "neutral_count", "mixed_count", "evidence_count", "unique_users",
        F.round("mass", 9).alias("effective_evidence"), F.round(F.when(known, share_p), 9).alias("weighted_positive_ratio"), F.round(F.when(known, share_n), 9).alias("weighted_negative_ratio"),
        F.round(F.when(known, confidence).otherwise(0.0), 9).alias("confidence"), F.coalesce(known & (share_p >= conflict) & (share_n >= conflict), F.lit(False)).alias("conflict"), "latest",
    )


def evidence_score(rows: DataFrame, keys: list[str], per_side: int = 5, half_life_days: float = 730.0) -> DataFrame:
    """(keys, n_positive, n_negative, evidence_score) from ``rows`` (keys, evidence_id, direction, similarity, event_time, cutoff_time).

    The ``per_side`` heaviest pieces of each direction count, a piece weighing similarity times age decay; a side is its
    mean weight times log-count reliability, and the score is 0.5 moved up and down by the halves of the sides.
    """
    w = F.round(c("similarity") * S.half_life_weight(S.age_days(c("event_time"), c("cutoff_time")), half_life_days), 9)
    rows = rows.where("event_time < cutoff_time and direction in ('positive', 'negative')").withColumn("w", w)
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "direction").orderBy(c("w").desc(), "evidence_id"))).where(c("r") <= per_side)
    side = lambda d: F.coalesce(F.avg(F.when(c("direction") == d, c("w"))) * F.log1p(F.count_if(c("direction") == d)) / F.log(F.lit(per_side + 1.0)), F.lit(0.0))
    g = top.groupBy(*keys).agg(F.count_if(c("direction") == "positive").alias("n_positive"), F.count_if(c("direction") == "negative").alias("n_negative"), side("positive").alias("p"), side("negative").alias("n"))
    return g.select(*keys, "n_positive", "n_negative", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * c("p") - 0.5 * c("n"))), 9).alias("evidence_score"))


def consensus(rows: DataFrame, keys: list[str], conflict_count: int = 2, conflict_share: float = 0.3, majority: float = 0.6, prior: float = 3.0, target_users: int = 3, citations: int = 3) -> DataFrame:
    """Per key of ``rows`` (keys, evidence_id, user_id, stance, weight, relevance, recency): masses, consensus, confidence and citations.

    Stances are supports, contradicts and neutral. Consensus is the stance with ``majority`` of the mass, mixed
    otherwise or in conflict (both sides have pieces and mass enough), insufficient without mass. Confidence multiplies
    mean relevance, mean recency, consistency, user diversity and sample strength.
    """
    is_ = lambda s: c("stance") == s
    cited = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(is_("neutral"), 1).otherwise(0), c("weight").desc(), "evidence_id"))
    g = rows.withColumn("r", cited).groupBy(*keys).agg(
        F.count("*").alias("evidence_count"), F.countDistinct("user_id").alias("users"), F.count_if(is_("supports")).alias("support_count"), F.count_if(is_("contradicts")).alias("contradiction_count"),
        F.coalesce(F.sum(F.when(is_("supports"), c("weight"))), F.lit(0.0)).alias("sm"), F.coalesce(F.sum(F.when(is_("contradicts"), c("weight"))), F.lit(0.0)).alias("cm"), F.avg("relevance").alias("rel"), F.avg("recency").alias("rec"),
        F.array_sort(F.collect_list(F.when((c("r") <= citations) & ~is_("neutral"), F.struct("r", "evidence_id")))).alias("top"),  # at most ``citations`` entries
    )
    total = c("sm") + c("cm")
    share = lambda n: F.coalesce(c(n) / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    conflicting = (c("support_count") >= conflict_count) & (c("contradiction_count") >= conflict_count) & (F.least(share("sm"), share("cm")) >= conflict_share)
    verdict = F.when(total <= 0, "insufficient").when(conflicting, "mixed").when(share("sm") >= majority, "supports").when(share("cm") >= majority, "contradicts").otherwise("mixed")
    confidence = c("rel") * c("rec") * F.greatest(share("sm"), share("cm")) * F.least(F.lit(1.0), c("users") / target_users) * c("evidence_count") / (c("evidence_count") + prior)
    return g.select(
        *keys, "evidence_count", "support_count", "contradiction_count", F.round("sm", 9).alias("support_mass"), F.round("cm", 9).alias("contradiction_mass"), verdict.alias("consensus"), conflicting.alias("has_conflict"),
        F.round(confidence, 9).alias("confidence"), F.array_join(F.transform("top", lambda x: x["evidence_id"].cast("string")), ",").alias("citations"),
    )
