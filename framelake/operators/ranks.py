"""Numbering the rows of a group without gathering a large group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ids of one cell; a group is numbered cell by cell, each by a task of its own.
CELL_IDS = 100_000


def numbered(df: DataFrame, keys: list[str], by: str, name: str, cell_ids: int = CELL_IDS) -> DataFrame:
    """df with name: 1, 2, .. of each row within its keys, by the whole number in by, which tells rows apart."""
    rows = df.withColumn("_cell", F.floor(F.col(by) / cell_ids))
    own = Window.partitionBy(*keys, "_cell").orderBy(by)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_nth", F.row_number().over(own)).join(cells, [*keys, "_cell"])
    return ranked.withColumn(name, F.col("_before") + F.col("_nth")).drop("_cell", "_nth", "_before")
