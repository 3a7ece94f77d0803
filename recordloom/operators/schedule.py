"""Timings of visits relative to the anchor of their timeline."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import TIME_UNITS
from ..functions.text import number_text


def window_text(before: Column, after: Column, unit: Column) -> Column:
    """`-before..after unit`; missing ends are 0, fractions give null."""
    low, high = F.coalesce(number_text(before), F.lit("0")), F.coalesce(number_text(after), F.lit("0"))
    whole = ~F.contains(F.concat(low, high), F.lit("."))
    return F.when(whole & unit.isNotNull(), F.concat(F.lit("-"), low, F.lit(".."), high, F.lit(" "), F.lower(F.trim(unit))))


def timings(visits: DataFrame, timeline: list[str], pos: str) -> DataFrame:
    """*timeline, pos, key, timepoint, type, value, relative_to, window and note of every visit; type is null where it gets no timing.

    visits: key, timepoint (its name), anchor, offset_value, unit, direction (after, before), win_before, win_after and win_unit. A timeline's
    anchor is the marked visit, or else its first. It is the fixed reference at 0 days, without a window. Others are so many whole units of time
    before or after it; where several are marked only the first is timed, as the others' distances mean nothing then.
    """
    all_ = Window.partitionBy(*timeline)
    marked = F.coalesce(F.col("anchor"), F.lit(False))
    n = F.sum(marked.cast("int")).over(all_)
    first = F.min(F.struct((~marked).cast("int").alias("late"), F.col(pos).alias("at"), F.col("timepoint").alias("timepoint"))).over(all_)
    rows = visits.withColumns({"_n": n, "_first": first})
    own = F.col(pos) == F.col("_first.at")
    amount, unit = number_text(F.col("offset_value")), F.lower(F.trim("unit"))
    fits = amount.isNotNull() & ~F.contains(amount, F.lit(".")) & F.coalesce(unit.isin(TIME_UNITS), F.lit(False))
    timed = ~own & (F.col("_n") <= 1) & (F.col("_n") == 1) & fits
    kind = F.when(own, "Fixed Reference").when(timed, F.when(F.col("direction") == "after", "After").otherwise("Before"))
    value = F.when(own, "0 days").when(timed, F.concat(amount, F.lit(" "), unit))
    note = (
        F.when(own & (F.col("_n") > 1), F.concat(F.col("_n").cast("string"), F.lit(" anchors: only the first is timed"))).when(own & (F.col("_n") == 0), "no anchor stated: the first visit is taken")
        .when(own & F.col("win_unit").isNotNull(), "the anchor has no window").when(own, None).when(F.col("_n") != 1, None).when(F.col("offset_value").isNull(), "no planned time stated").when(~fits, "the planned time is no whole number of a time unit")
    )
    return rows.select(
        *timeline, pos, "key", "timepoint", kind.alias("type"), value.alias("value"), F.when(kind.isNotNull(), F.col("_first.timepoint")).alias("relative_to"),
        F.when(timed, window_text(F.col("win_before"), F.col("win_after"), F.col("win_unit"))).alias("window"), note.alias("note"),
    )


def encounter_windows(encounters: DataFrame, timed: DataFrame, timeline: str, main: str, visit: str) -> DataFrame:
    """encounters of the main timeline with scheduled_by: the timepoint whose timing schedules them; others keep null."""
    of_main = timed.where((F.col(timeline) == main) & F.col("type").isNotNull()).select(F.col("key").alias(visit), F.concat("timepoint", F.lit(" timing")).alias("scheduled_by")).distinct()
    return encounters.join(of_main, visit, "left")
