"""Gapless ranks of a sorted table without a window over all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import saved


def ranked(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Adds the gapless rank (from 0) of each row in the given order, within each group of the first columns.

    Range partitions are cut by all sort columns, so a group with a third of the rows is spread over many
    tasks; only one count per partition and group meets in a window. The sorted rows are saved once, since a
    partition's number must not change between the two uses.
    """
    within = within or []
    keys = [F.col(c) for c in [*within, *order]]
    rows = saved(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = saved(counts.select("_part", *within, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    same: list[Column] = [rows["_part"] == starts["_part"], *(rows[c].eqNullSafe(starts[c]) for c in within)]
    kept = [rows[c] for c in df.columns]
    return rows.join(starts, same).select(*kept, (rows["_at"] - F.col("_first") + F.col("_before")).alias(name))
