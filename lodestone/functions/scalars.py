"""Column functions of the engine. All stay in the JVM; a null input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres, with the root's argument clamped to 0..1."""
    inner = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner))))


def distance_decay(km: Column, scale_km: float) -> Column:
    """exp(-km / scale); an unknown distance counts 0.5."""
    return F.coalesce(F.exp(-km / scale_km), F.lit(0.5))


def micros(time: Column) -> Column:
    """Microseconds of a zone-less time since 1970-01-01, the same in every session zone and monotone in all of them."""
    since = time.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    return ((part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def age_days(event: Column, reference: Column) -> Column:
    """Days from ``event`` to ``reference`` with microseconds kept."""
    return (micros(reference) - micros(event)) / 86_400e6


def half_life_weight(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def hash_order(seed: str, *ids: Column) -> Column:
    """SHA-256 of ``seed:id...`` in hexadecimal: a reproducible random order."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *ids), 256)


def hash_fold(seed: str, identity: Column, folds: int) -> Column:
    """The whole 256-bit hash modulo ``folds``, plus one, by Horner's rule over its hexadecimal digits."""
    digits = F.split(hash_order(seed, identity), "")
    step = lambda acc, d: F.pmod(acc * 16 + F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0)), F.lit(folds))
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), step) + 1


def hash_bucket(seed: str, identity: Column, buckets: int) -> Column:
    """The first eight bytes of the hash as an unsigned number modulo ``buckets``."""
    head = F.conv(F.substring(hash_order(seed, identity), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def rank_percentile(rank: Column, size: Column) -> Column:
    """(n - rank) / (n - 1), which is 1 for the first and 0 for the last; 1 where n is 1."""
    return F.when(size <= 1, F.lit(1.0)).otherwise((size - rank) / F.nullif(size - 1, F.lit(0)))


def humanize(name: Column) -> Column:
    """``RestaurantsPriceRange_2`` as ``restaurants price range 2``."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(spaced, "_+", " ")), r"\s+", " "))


def comma_list(text: Column) -> Column:
    """The trimmed, non-blank parts of a comma-separated text."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def tri_state(text: Column) -> Column:
    """true, false or null for the spellings found in attribute dumps, such as ``u'free'`` and ``'no'``."""
    plain = F.lower(F.regexp_replace(F.trim(text), r"^u?['\"]|['\"]$", ""))
    return F.when(plain.isin("true", "yes", "free", "paid", "1"), True).when(plain.isin("false", "no", "none", "0"), False)


def normalized_words(text: Column) -> Column:
    """Lower case without any character that is no letter, digit or underscore: equal for texts that differ in marks."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine with norms floored at 1e-12."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return dot(left, right) / (norm(left) * norm(right))


def open_at(start_minute: Column, end_minute: Column, minute: Column) -> Column:
    """Whether a day's span holds the minute: an end before the start runs overnight, equal ends mean closed, null is unknown."""
    return F.when(start_minute == end_minute, False).when(start_minute < end_minute, (minute >= start_minute) & (minute < end_minute)).otherwise(
        F.when(start_minute.isNotNull() & end_minute.isNotNull(), (minute >= start_minute) | (minute < end_minute))
    )


def open_in_week(start: Column, end: Column, start_before: Column, end_before: Column, minute: Column) -> Column:
    """Whether the day's span holds the minute, or the overnight span of the day before still does; unknown without the day's span, unless the latter does."""
    today = F.coalesce(open_at(start, end, minute) & ((start < end) | (minute >= start)), F.lit(False))
    late = F.coalesce((start_before > end_before) & (minute < end_before), F.lit(False))
    return F.when(today | late, True).when(start.isNull() | end.isNull(), F.lit(None)).otherwise(False)
