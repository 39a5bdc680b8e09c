"""Scalar expressions: time features, scores, vectors, names. All are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config as C


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def hour_block(ts: Column, hours: int = C.BUCKET_HOURS) -> Column:
    if 24 % hours:
        raise ValueError(f"24 is not divisible by {hours}")
    return F.floor(F.hour(ts) / hours).cast("int")


def is_weekend(ts: Column) -> Column:
    return weekday(ts) >= 5


def fractional_hour(ts: Column) -> Column:
    """Hour with minutes and whole seconds."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0)


def time2vec(t: Column, size: int = C.TIME2VEC) -> Column:
    """t and the sines of its first size - 1 harmonics of a day."""
    return F.array(t.cast("double"), *[F.sin(F.lit(6.283185307179586 * k) * t / F.lit(24.0)) for k in range(1, size)])


def learned_time2vec(tau: Column, weights: list[float], phases: list[float]) -> Column:
    """A linear term, then sines, of given frequencies and phases."""
    linear = tau * F.lit(weights[0]) + F.lit(phases[0])
    return F.array(linear, *[F.sin(tau * F.lit(w) + F.lit(p)) for w, p in zip(weights[1:], phases[1:], strict=True)])


def finite_or_zero(v: Column) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))


def value_norm(v: Column, mean: Column, std: Column) -> Column:
    return (finite_or_zero(v) - mean) / (std + F.lit(C.VALUE_EPS))


def z_score(v: Column, mean: Column, std: Column) -> Column:
    """0 where the spread is 0."""
    return F.when(std > 0, (v - mean) / std).otherwise(F.lit(0.0))


def robust_z(v: Column, median: Column, mad: Column) -> Column:
    return F.when(mad > 0, F.lit(C.ROBUST_CONSTANT) * (v - median) / mad).otherwise(F.lit(0.0))


def middle(sorted_values: Column) -> Column:
    """The median of a sorted array; 0 of an empty one."""
    n = F.size(sorted_values)
    at = lambda i: F.get(sorted_values, i)
    half = F.floor(n / F.lit(2)).cast("int")
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / F.lit(2.0))


def median_and_mad(values: Column) -> tuple[Column, Column]:
    med = middle(F.array_sort(values))
    return med, middle(F.array_sort(F.transform(values, lambda x: F.abs(x - med))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector passes."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_from_squared(d: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - d / F.lit(2.0)


def cloud(namespace: Column, resource: Column, uri: Column, category: Column, component: Column) -> Column:
    """The provider that identifiers point to; the order of the rules counts."""
    ns, rid, uri, cat, comp = (F.coalesce(c, F.lit("")) for c in (namespace, resource, uri, category, component))
    starts = lambda c, *p: F.array_contains(F.array(*[c.startswith(x) for x in p]), True)
    has = lambda word, *cs: F.array_contains(F.array(*[c.contains(word) for c in cs]), True)
    # Prefixes and words of each provider.
    return (
        F.when(starts(rid, "i-", "sg-", "vol-", "arn:aws") | has("AWS", ns, uri, cat) | (comp == "EC2") | has("EC2", cat), "AWS")
        .when(starts(rid, "ocid") | starts(F.lower(ns), "oci") | has("OCI", uri, cat), "OCI")
        .when(has("/subscriptions/", rid) | starts(ns, "Microsoft") | has("Azure", uri, cat) | has("Virtual_Machines", cat), "Azure")
        .when(has("compute.googleapis", rid) | has("projects/", rid) | has("GCP", uri, cat), "GCP")
        .otherwise("Unknown")
    )


def hourly_values(entries: Column) -> Column:
    """Of an array of maps: the first of Average, average and Sum that is there and not 0 (Sum may be 0)."""
    nonzero = lambda e, k: F.nullif(F.try_element_at(e, F.lit(k)), F.lit(0.0))
    return F.transform(entries, lambda e: F.coalesce(nonzero(e, "Average"), nonzero(e, "average"), F.try_element_at(e, F.lit("Sum"))))


def anchor_type(transition: Column, state: Column) -> Column:
    spike = (transition == "OK_TO_FIRING") | (state == "FIRING")
    return F.when(spike, "spike").when((transition == "FIRING_TO_OK") | (state == "OK"), "recovery").otherwise("spike")


def first_filled(*names: Column, default: str = "unknown") -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in names], F.lit(default))


def short_hash(c: Column, length: int = 8) -> Column:
    return F.substring(F.md5(c), 1, length)


def vector_key(a: Column) -> Column:
    return F.substring(F.sha2(F.to_json(a), 256), 1, 8)


def state_key(entity: Column, metric: Column, hour: Column, weekend: Column) -> Column:
    """prefix:entity:metric:hourHH[:weekday|:weekend], or :global where there is no hour."""
    block = F.concat(F.lit("hour"), F.lpad(hour.cast("string"), 2, "0"))
    side = F.when(weekend, ":weekend").when(~weekend, ":weekday").otherwise("")
    return F.concat_ws(":", F.lit(C.STATE_PREFIX), entity, metric, F.when(hour.isNull(), "global").otherwise(F.concat(block, side)))


def unit_draw(*keys: Column) -> Column:
    """A number in [0, 1) fixed by the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def embed_dim(vocabulary: int) -> int:
    """Width of a categorical embedding."""
    return max(4, min(vocabulary // 2, 32))


def cells_for(n: int, wanted: int = C.N_LIST) -> int:
    """Cells of an index over n vectors: 39 vectors a cell at least."""
    return max(1, min(wanted, max(1, n // 39), n))
