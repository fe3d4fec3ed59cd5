"""Changes of collections, as UPDATE makes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_empty(c: Column, like: Column) -> Column:
    return F.coalesce(c, F.slice(like, 1, 0))


def append(c: Column, more: Column) -> Column:
    return F.concat(_or_empty(c, more), more)


def prepend(c: Column, more: Column) -> Column:
    return F.concat(more, _or_empty(c, more))


def remove(c: Column, gone: Column) -> Column:
    """All occurrences of the given elements taken out; order and other repeats stay."""
    return F.filter(c, lambda v: ~F.array_contains(gone, v))


def set_add(c: Column, more: Column) -> Column:
    return F.array_sort(F.array_union(_or_empty(c, more), more))


def set_remove(c: Column, gone: Column) -> Column:
    return F.array_sort(F.array_except(c, gone))


def map_put(c: Column, more: Column) -> Column:
    """Entries added; those given last win."""
    old = F.map_filter(c, lambda k, v: ~F.map_contains_key(more, k))
    return F.when(c.isNull(), more).otherwise(F.map_concat(old, more))


def map_remove(c: Column, keys: Column) -> Column:
    return F.map_filter(c, lambda k, v: ~F.array_contains(keys, k))


def list_put(c: Column, at: Column, value: Column) -> Column:
    """Element ``at`` (from 0) replaced; null where there is none."""
    return F.when(at < F.size(c), F.transform(c, lambda v, i: F.when(i == at, value).otherwise(v)))
