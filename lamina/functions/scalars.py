"""Scalar functions: name to a builder of Columns. A name that is not here is looked up in Spark's own registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds between 1582-10-15, where time-based UUIDs count from, and 1970.
UUID_EPOCH_MICROS = 12_219_292_800_000_000


def token(*keys: Column) -> Column:
    """Where a partition key stands on the ring: Spark's xxHash64, which is not the hash of any other system."""
    return F.xxhash64(*keys)


def timeuuid_micros(u: Column) -> Column:
    """Microseconds since 1970 of a time-based UUID: its 60-bit count of 100 ns."""
    high = F.concat(F.substring(u, 16, 3), F.substring(u, 10, 4), F.substring(u, 1, 8))
    return (F.floor(F.conv(high, 16, 10).cast("decimal(20,0)") / 10) - UUID_EPOCH_MICROS).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle of two vectors; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def total(c: Column) -> Column:
    """Sum of a collection, as double; 0 if empty."""
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double"))


SCALARS: dict[str, Callable[..., Column]] = {
    "token": token,
    "textasblob": lambda c: F.encode(c, "utf-8"),
    "blobastext": lambda c: F.decode(c, "utf-8"),
    "todate": F.to_date,
    "date": F.to_date,
    "totimestamp": lambda c: c.cast("timestamp"),
    "tounixtimestamp": lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("long"),
    "dateof": lambda c: F.timestamp_micros(timeuuid_micros(c)),
    "unixtimestampof": lambda c: F.floor(timeuuid_micros(c) / 1000).cast("long"),
    "uuid": F.uuid,
    "abs": F.abs,
    "exp": F.exp,
    "log": F.ln,
    "ln": F.ln,
    "log10": F.log10,
    "round": lambda c, n=None: F.round(c) if n is None else F.round(c, n),
    "similarity_cosine": lambda a, b: (1 + cosine(a, b)) / 2,
    "cosine_similarity": cosine,
    "similarity_euclidean": lambda a, b: 1 / (1 + F.pow(euclidean(a, b), F.lit(2.0))),
    "euclidean_distance": euclidean,
    "similarity_dot_product": lambda a, b: (1 + dot(a, b)) / 2,
    "dot_product": dot,
    "mask_default": lambda c: F.mask(c.cast("string")),
    "mask_null": lambda c: F.lit(None),
    "mask_replace": lambda c, v: v,
    "mask_inner": lambda c, a, b: _masked(c, a, b, True),
    "mask_outer": lambda c, a, b: _masked(c, a, b, False),
    "mask_hash": lambda c: F.sha2(c.cast("string"), 256),
    "tojson": F.to_json,
    "collection_count": F.size,
    "collection_min": F.array_min,
    "collection_max": F.array_max,
    "collection_sum": total,
    "collection_avg": lambda c: F.try_divide(total(c), F.size(c)),
    "map_keys": F.map_keys,
    "map_values": F.map_values,
    "is_empty": lambda c: F.size(c) == 0,
    "default_if_null": F.coalesce,
}


def _masked(c: Column, left: Column, right: Column, inner: bool) -> Column:
    """Stars for what lies between the first ``left`` and last ``right`` characters, or for those."""
    s = c.cast("string")
    n = F.length(s)
    lo, hi = F.least(left, n), F.greatest(n - right, F.least(left, n))
    star = lambda k: F.repeat(F.lit("*"), k.cast("int"))
    if inner:
        return F.concat(F.substr(s, F.lit(1), lo), star(hi - lo), F.substr(s, hi + 1, n - hi))
    return F.concat(star(lo), F.substr(s, lo + 1, hi - lo), star(n - hi))
