"""Page lines to clean text: islands, as-of sections."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def body_size(lines: DataFrame, within: list[str], size: str, weight: str) -> DataFrame:
    """The size that carries most weight in each group; the smallest of equals."""
    sums = lines.groupBy(*within, size).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*within).agg(F.max_by(size, F.struct("w", -F.col(size))).alias("body_size"))


def islands(rows: DataFrame, within: list[str], order: list[str], starts) -> DataFrame:
    """Numbers runs of rows from 1: a row where `starts` holds (or the first) begins a new one."""
    w = Window.partitionBy(*within).orderBy(*order)
    flag = F.when(starts(w) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return rows.withColumn("_new", flag).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def as_of(rows: DataFrame, within: list[str], order: list[str], mark: str) -> DataFrame:
    """Fills `mark` forward: each row gets the last one at or before it in its group."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(mark, F.last(mark, ignorenulls=True).over(w))


def next_or_exit(rows: DataFrame, within: list[str], order: list[str], name: str, out: str = "next_name") -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    return rows.withColumn(out, F.coalesce(F.lead(name).over(w), F.lit("(Exit)")))
