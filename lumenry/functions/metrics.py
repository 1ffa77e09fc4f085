"""Retrieval metrics of one ranked list, as Column expressions over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hits(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, max(k, 0)) if k > 0 else F.slice(retrieved, 1, 0), relevant))


def recall(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 0 where nothing is relevant."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, hits(retrieved, relevant, k) / n).otherwise(0.0)


def precision(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of relevant ids among those returned, k at most; 0 where nothing is returned."""
    shown = F.least(F.size(retrieved), F.lit(k))
    return F.when(shown > 0, F.size(F.filter(F.slice(retrieved, 1, max(k, 1)), lambda x: F.array_contains(relevant, x))) / shown).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """One over the place of the first relevant id; 0 where there is none."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.element_at(places, 1)).otherwise(0.0)
