"""Reuse of lazily built frames: one analysis of a stage, however many operators stand on it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame


def once_per_frame(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Remembers the (lazy) result per input frame; no data is kept, only the analyzed plan."""
    made: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()

    @functools.wraps(build)
    def wrapped(df: DataFrame) -> DataFrame:
        if df not in made:
            made[df] = build(df)
        return made[df]

    return wrapped
