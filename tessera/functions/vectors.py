"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the length of the shorter vector; 0.0 if either has no norm or is null."""
    size = F.least(F.size(a), F.size(b))
    x = F.slice(a.cast("array<double>"), F.lit(1), F.greatest(size, F.lit(0)))
    y = F.slice(b.cast("array<double>"), F.lit(1), F.greatest(size, F.lit(0)))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.coalesce(F.when(norm > 0, dot(x, y) / norm), F.lit(0.0))
