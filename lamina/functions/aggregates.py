"""Aggregate and window functions: name to a builder of Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev,
    "variance": F.variance,
    "approx_count_distinct": F.approx_count_distinct,
    "first": F.first,
    "last": F.last,
    "collect_list": F.collect_list,
    "collect_set": F.collect_set,
    "max_by": F.max_by,
    "min_by": F.min_by,
    "percentile_approx": F.percentile_approx,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
}
#: Aggregates of distinct values, where the plain one has no other form.
DISTINCT: dict[str, Callable[..., Column]] = {
    "count": F.count_distinct,
    "sum": F.sum_distinct,
    "avg": lambda c: F.sum_distinct(c.cast("double")) / F.count_distinct(c),
    "min": F.min,
    "max": F.max,
    "collect_list": F.collect_set,
    "collect_set": F.collect_set,
}
WINDOWS: dict[str, Callable[..., Column]] = {
    "row_number": F.row_number,
    "rank": F.rank,
    "dense_rank": F.dense_rank,
    "percent_rank": F.percent_rank,
    "cume_dist": F.cume_dist,
    "ntile": F.ntile,
    "lag": F.lag,
    "lead": F.lead,
    "first_value": F.first,
    "last_value": F.last,
}
