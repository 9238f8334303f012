"""Facets of a growing catalog, kept by roll-ups that are merged, so that no facet reads the catalog again.

Exact counts are sums by source, month, facet and value; they merge by addition, and rows that went are counted with -1.
Distinct values across sources and months don't add up, so each cell also has a sketch of them, which unites with others.
The sketches have 2**LG_K slots: their standard error is 1.04 / sqrt(2**LG_K), 1.6 % at 12. They know no removal; the
roll-ups of a source or month that lost rows are made anew from its own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12


def part(rows: DataFrame, facets: dict[str, Column], month: Column, sketched: dict[str, Column], sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """(counts, sketches) of some rows: source_id, month, facet, value, n; and source_id, month, name, sketch."""
    each = F.array(*(F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in facets.items()))
    own = rows.select("source_id", month.alias("month"), F.explode(each).alias("x")).select("source_id", "month", "x.*")
    counts = own.groupBy("source_id", "month", "facet", "value").agg((F.count("*") * sign).alias("n"))
    sketches = rows.withColumn("month", month).groupBy("source_id", "month").agg(*(F.hll_sketch_agg(v.cast("string"), F.lit(LG_K)).alias(k) for k, v in sketched.items()))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("sketch")) for k in sketched)))
    return counts, sketches.select("source_id", "month", long.alias("x")).select("source_id", "month", "x.*")


def merged(counts: list[DataFrame], sketches: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Roll-ups of all parts together, as one part would have made them."""
    all_counts = reduce(DataFrame.unionByName, counts).groupBy("source_id", "month", "facet", "value").agg(F.sum("n").alias("n")).where("n <> 0")
    return all_counts, reduce(DataFrame.unionByName, sketches).groupBy("source_id", "month", "name").agg(F.hll_union_agg("sketch").alias("sketch"))


def facet(counts: DataFrame, name: str) -> DataFrame:
    """value, n over all sources and months."""
    return counts.where(F.col("facet") == name).groupBy("value").agg(F.sum("n").alias("n"))


def distinct(sketches: DataFrame, *by: str) -> DataFrame:
    """name, estimate of the distinct values, overall or by source_id or month."""
    return sketches.groupBy("name", *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
