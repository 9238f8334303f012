"""Joining what an operator found back to the rows that it was asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unused(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no such column."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def joined_back(docs: DataFrame, found: DataFrame, keys: dict[str, Column], take: dict[str, str]) -> DataFrame:
    """docs with columns of found (take: name in found -> new name), joined on keys (name in found -> of docs).

    Keys may be null and rows may repeat: equals are numbered on both sides and meet by number, so each row of
    found is used once.
    """
    taken = {v.lower() for v in take.values()}
    kept = [c for c in docs.columns if c.lower() not in taken]
    mine, count = {k: unused(docs, f"key_{k}") for k in keys}, unused(docs, "nth")
    nth = Window.partitionBy(*mine.values()).orderBy(*mine.values())
    left = docs.withColumns({mine[k]: v for k, v in keys.items()}).select(*(F.col(f"`{c}`") for c in kept), *mine.values(), F.row_number().over(nth).alias(count))
    other = Window.partitionBy(*keys).orderBy(*take)
    right = found.select(*(F.col(k).alias(f"other {k}") for k in keys), *(F.col(k).alias(v) for k, v in take.items()), F.row_number().over(other).alias("other nth"))
    on = left[count] == right["other nth"]
    for k, own in mine.items():
        on = on & left[own].eqNullSafe(right[f"other {k}"])
    return left.join(right, on).select(*(left[f"`{c}`"] for c in kept), *(right[v] for v in take.values()))
