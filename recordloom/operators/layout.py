"""Pages, sections and tables of documents: running lines, contents pages, section texts, grids."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_page_label, repeat_key
from ..session import importable

# What marks a contents line, a schedule's heading cell, a filled mark and a caption.
LEADER = r"(\.{4,}|…{2,}|(\. ){4,})\s*[0-9]{1,4}\s*$"
CONTENTS = r"(?i)^(table of contents|contents|list of (tables|figures|appendices|attachments|in-text tables))\b"
VISIT = r"(?i)\b(screening|baseline|days?|weeks?|wk|visit|cycle|months?|follow[- ]?up|end of (treatment|study|trial)|randomi[sz]ation|treatment (period|phase)|eot|eos|unscheduled|early (termination|discontinuation)|run[- ]in|washout|v[0-9]+|d-?[0-9]+|w-?[0-9]+|c[0-9]+)\b"
CAPTION = r"(?i)^(table|figure|exhibit)\s+[\w.\-]+"
MARK = r"(?i)^(x|✓|✔|√|•|●|y|yes|\(x\)|x\s?[a-z,0-9]{1,6})$"


def running_lines(lines: DataFrame, within: list[str], page: str, text: str, in_band: Column, share: float = 0.25) -> DataFrame:
    """Lines of the top and bottom bands whose key is on at least max(3, share) of the group's pages, and page labels there.

    Keys are counted by partial aggregates; only one row per key meets the lines again.
    """
    pages = lines.groupBy(*within).agg(F.countDistinct(page).alias("_pages"))
    band = lines.where(in_band).withColumn("_key", repeat_key(F.col(text)))
    on = band.groupBy(*within, "_key").agg(F.countDistinct(page).alias("_on"))
    often = on.join(pages, within).where(F.col("_on") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * share))).select(*within, "_key", F.lit(True).alias("_often"))
    found = band.join(often, [*within, "_key"], "left")
    return found.where(F.col("_often").isNotNull() | is_page_label(F.col("_key"))).select(*lines.columns)


def is_noise(size: Column, body: Column, text: Column) -> Column:
    """Stamps: two and a half times the body size or more, eight characters at most."""
    return (size >= 2.5 * body) & (F.char_length(text) <= 8)


def contents_pages(lines: DataFrame, within: list[str], text: str, nth: str) -> DataFrame:
    """Pages (groups of lines) with five dotted lines, or a contents title in the first eight and two, or two in five lines."""
    leaders = F.sum(F.when(F.col(text).rlike(LEADER), 1).otherwise(0))
    titled = F.max(F.when((F.col(nth) < 8) & F.col(text).rlike(CONTENTS), 1).otherwise(0))
    counts = lines.groupBy(*within).agg(leaders.alias("leaders"), titled.alias("titled"), F.count("*").alias("n"))
    return counts.where("leaders >= 5 or (titled = 1 and leaders >= 2) or leaders >= 0.4 * n").select(*within, "leaders", "n")


def section_texts(lines: DataFrame, section: list[str], order: list[str], page: str, text: str) -> DataFrame:
    """Text and page range of every section: its lines in order, [[PAGE n]] before the first and at each change of page."""
    w = Window.partitionBy(*section).orderBy(*order)
    turned = ~F.lag(page).over(w).eqNullSafe(F.col(page))
    marked = lines.withColumn("_line", F.when(turned, F.concat(F.lit("[[PAGE "), page, F.lit("]]\n"), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "_line")))
    out = marked.groupBy(*section).agg(ordered.alias("_all"), F.min(page).alias("page_start"), F.max(page).alias("page_end"))
    return out.select(*section, "page_start", "page_end", F.array_join(F.transform("_all", lambda x: x["_line"]), "\n").alias("text"))


def _ends(table: pa.Table) -> pa.Table:
    """The last page of each row and of the rows below it: from the end, what a row closes is below it."""
    table = table.sort_by("_pos")
    levels, ends = table["_level"].to_pylist(), table["_end"].to_pylist()
    open_: list[int] = []
    for i in range(len(levels) - 1, -1, -1):
        while open_ and levels[open_[-1]] > levels[i]:
            below = ends[open_.pop()]
            ends[i] = below if ends[i] is None else ends[i] if below is None else max(ends[i], below)
        open_.append(i)
    return table.drop_columns(["_end"]).append_column("_end", pa.array(ends, table["_end"].type))


def page_ends(sections: DataFrame, within: list[str], pos: str, level: str, end: str) -> DataFrame:
    """Page ends extended over each section's subtree: the rows up to the next of its level or a smaller one. Levels may be of any depth.

    A document's positions, levels and ends, and nothing else, go through one pass from its end.
    """
    importable(sections.sparkSession)
    thin = sections.select(*within, F.col(pos).alias("_pos"), F.col(level).alias("_level"), F.col(end).alias("_end"))
    return thin.groupBy(*within).applyInArrow(_ends, thin.schema).select(*within, F.col("_pos").alias(pos), F.col("_level").alias(level), F.col("_end").alias(end))


def grid_shape(cells: Column) -> dict[str, Column]:
    """rows, cols, merged (null) cells, share of empty cells, and the header's signature of a grid."""
    flat = F.flatten(cells)
    empty = F.size(F.filter(flat, lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""))
    return {
        "n_rows": F.size(cells),
        "n_cols": F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)),
        "merged": F.size(F.filter(flat, lambda c: c.isNull())),
        "empty_ratio": F.when(F.size(flat) > 0, F.round(empty / F.size(flat), 3)).otherwise(1.0),
        "header": F.array_join(F.transform(F.get(cells, F.lit(0)), lambda c: F.substring(F.lower(F.coalesce(c, F.lit(""))), 1, 20)), "|"),
    }


def schedule_score(cells: Column, page_hint: Column) -> Column:
    """How much a grid looks like a schedule of visits, 0 to 1; 0 below three rows or columns."""
    shape = grid_shape(cells)
    heads = F.size(F.filter(F.flatten(F.slice(cells, 1, 3)), lambda c: F.coalesce(c.rlike(VISIT), F.lit(False))))
    body = F.filter(F.flatten(F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda r: F.slice(r, F.lit(2), F.size(r)))), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    marks = F.size(F.filter(body, lambda c: F.trim(c).rlike(MARK))) / F.greatest(F.size(body), F.lit(1))
    score = 0.4 * F.least(heads / 4, F.lit(1.0)) + 0.4 * F.least(marks / 0.25, F.lit(1.0)) + F.when(shape["n_cols"] >= 5, 0.05).otherwise(0.0) + F.when(page_hint, 0.15).otherwise(0.0)
    return F.when((shape["n_rows"] < 3) | (shape["n_cols"] < 3), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 3))


def captions(tables: DataFrame, lines: DataFrame, on: list[str], table_id: str, top: str, bottom: str, text: str) -> DataFrame:
    """The lowest caption line that ends at most 40 points above each table; lines and tables meet by page only."""
    named = lines.where(F.col(text).rlike(CAPTION)).select(*on, F.col(bottom).alias("_bottom"), F.col(text).alias("_text"))
    near = tables.select(*on, table_id, top).join(named, on).where((F.col("_bottom") <= F.col(top) + 2) & (F.col(top) - F.col("_bottom") <= 40))
    best = near.groupBy(*on, table_id).agg(F.max_by("_text", "_bottom").alias("caption"))
    return tables.join(best, [*on, table_id], "left")
