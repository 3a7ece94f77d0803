"""Joins with a table of unique keys in which some keys may hold a large part of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import saved

#: A key is heavy if it holds more than this part of the rows, so at most SHARE keys are.
SHARE = 1000


def met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join of rows with table, which has one row per key.

    Rows of heavy keys meet their few rows of the table (at most SHARE) where they are, so no task gets a heavy
    key whole; the others are shuffled. Both should be saved tables, since rows is read three times. Rows with
    a null key are left out.
    """
    total = rows.count()
    heavy = saved(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(f"_n * {SHARE} > {total}").drop("_n"))
    light = rows.join(F.broadcast(heavy), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(table.join(F.broadcast(heavy), keys)), keys).unionByName(light)
