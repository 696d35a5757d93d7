"""Statistics that stay defined on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both sides are present, as an aggregate.

    NULL where either side has no variance (one value, or no rows), where the
    built-in ``corr`` divides by zero and ends the job under ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
