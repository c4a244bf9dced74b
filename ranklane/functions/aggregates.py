"""Aggregates that Spark lacks in this form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation; null, not an error, where a side is constant or there is one row."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
