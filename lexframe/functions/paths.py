"""Paths as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """A path without ``.`` segments, ``..`` taking back the segment before it (never above the top)."""
    return F.array_join(F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda kept, x: F.when(x == ".", kept)
        .when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(x))),
    ), "/")
