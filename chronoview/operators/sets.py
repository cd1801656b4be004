"""Set operations on views: subset checks, aligned unions, label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outside(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Distinct rows of ``part`` that ``whole`` does not have; both need the same columns in the same order."""
    if part.columns != whole.columns:
        raise ValueError("columns differ")
    return part.distinct().join(whole.distinct(), [part[c].eqNullSafe(whole[c]) for c in part.columns], "left_anti")


def restore(base: DataFrame, restored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Restored rows take the place of visible copies; columns are aligned by name."""
    return base.join(restored.select(*keys), list(keys), "left_anti").unionByName(restored, allowMissingColumns=True)


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def contained(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0
