"""Row numbers over a whole table without a task that sees all rows, and single rows side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.plans.checkpoint import cut


def row_numbers(df: DataFrame, order: list, name: str = "rn") -> DataFrame:
    """df with name: the place of each row, from 1, in the total order of the columns of order.

    Rows are dealt out in ranges of the order and written down; a row's number is its place in its range and the rows
    of the ranges before it. Only one number for each range is summed up in one place.
    """
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns({k: F.col(c) if isinstance(c, str) else c[0] if isinstance(c, tuple) else c for k, c in keys.items()})
    by = [F.col(k).desc() if isinstance(c, tuple) else F.col(k).asc() for k, c in keys.items()]
    ranged = cut(keyed.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return ranged.withColumn(name, place).join(F.broadcast(starts), "_range").withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_range", "_start", *keys)


def descending(column) -> tuple:
    """A column of an order whose greatest value comes first."""
    return (F.col(column) if isinstance(column, str) else column,)


def one_row(*rows: DataFrame) -> DataFrame:
    """Single rows with different columns as one row."""
    all_rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return all_rows.agg(*(F.max(c).alias(c) for c in all_rows.columns))
