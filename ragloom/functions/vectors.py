"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, let


def fit_dimension(v, dim: int) -> Column:
    """Pad with 0.0 or cut to ``dim`` values."""
    def fit(x):
        pad = F.array_repeat(F.lit(0.0).cast("double"), F.greatest(F.lit(dim) - F.size(x), F.lit(0)))
        return F.slice(F.concat(x, pad), 1, dim)
    return let(F.transform(col_of(v), lambda e: e.cast("double")), fit)


def l2_norm(v) -> Column:
    x = col_of(v)
    return F.sqrt(F.aggregate(x, F.lit(0.0).cast("double"),
                              lambda acc, e: acc + e.cast("double") * e.cast("double")))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is returned unchanged."""
    def scale(x):
        return let(l2_norm(x), lambda n: F.when(n > 0, F.transform(x, lambda e: e / n)).otherwise(x))
    return let(F.transform(col_of(v), lambda e: e.cast("double")), scale)


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance, accumulated in DOUBLE."""
    diffs = F.zip_with(col_of(a), col_of(b),
                       lambda x, y: (x.cast("double") - y.cast("double")) *
                                    (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, d: acc + d)


def similarity_from_distance(d) -> Column:
    """R2: ``max(0, 1 - distance)``."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - col_of(d))
