"""Roll-ups and checks around documents, books and runs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_totals(lines: DataFrame, pages: DataFrame, doc: str, page: str) -> tuple[DataFrame, DataFrame]:
    """pages with chars, lines and removed (running) lines, and documents with their sums, landscape pages and contents pages.

    lines: text and running; pages: landscape and contents. Pages without lines count 0.
    """
    sums = lines.groupBy(doc, page).agg(F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("lines"), F.sum(F.col("running").cast("long")).alias("removed"))
    each = pages.join(sums, [doc, page], "left").fillna(0, ["chars", "lines", "removed"])
    whole = each.groupBy(doc).agg(
        F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "lines", "removed")), F.sum(F.col("landscape").cast("long")).alias("landscape"),
        F.array_sort(F.collect_list(F.when(F.col("contents"), F.col(page)))).alias("contents"),
    )
    return each, whole


def finished_tables(tables: DataFrame, doc: str, heading: str | None = None) -> DataFrame:
    """tables with their group's score, schedule (0.5 or more) and reasons to look at them.

    tables: group_id, score, n_rows, n_cols, merged, empty_ratio, landscape and under_schedule (below a heading of a schedule), which lifts tables of four columns
    to 0.6. Reasons: a schedule, merged cells over a twentieth, more than half of over three rows empty, wide on a landscape page.
    """
    score = F.max("score").over(Window.partitionBy(doc, "group_id"))
    lifted = F.when(F.col("under_schedule") & (F.col("n_cols") >= 4), F.greatest(score, F.lit(0.6))).otherwise(score)
    rows = tables.withColumn("group_score", F.round(lifted, 3))
    reasons = F.array_compact(F.array(
        F.when(F.col("group_score") >= 0.5, "schedule_of_activities_candidate"), F.when(F.col("merged") / F.greatest(F.col("n_rows") * F.col("n_cols"), F.lit(1)) > 0.05, "merged_cells"),
        F.when((F.col("empty_ratio") > 0.5) & (F.col("n_rows") > 3), "sparse_grid"), F.when(F.col("landscape") & (F.col("n_cols") >= 5), "landscape_wide_table"),
    ))
    return rows.withColumns({"schedule": F.col("group_score") >= 0.5, "reasons": reasons})


def rendered_contexts(chosen: DataFrame, sections: DataFrame, doc: str, order: str, tables: DataFrame) -> DataFrame:
    """doc, topic and text: the sections of each topic in order, with their attributes, and tables in place of their markers.

    chosen: topic, doc and section_id; sections: number, title, page_start, page_end, text and order; tables: doc, table_id and markdown. A marker whose table is not there says so.
    """
    quoted = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    marker = r"\[\[TABLE ([^\]]+)\]\]"
    wanted = sections.join(chosen.select(doc, "section_id").distinct(), [doc, "section_id"], "left_semi")
    parts = wanted.select(doc, "section_id", F.posexplode(F.split("text", f"(?={marker})")).alias("_at", "_part")).withColumn("table_id", F.nullif(F.regexp_extract("_part", f"^{marker}", 1), F.lit("")))
    filled = parts.join(tables.select(doc, "table_id", "markdown"), [doc, "table_id"], "left")
    head = F.concat(F.lit("[[TABLE "), "table_id", F.lit("]]\n"), F.coalesce("markdown", F.lit("(table not available)")), F.lit("\n[[/TABLE]]"))
    piece = F.when(F.col("table_id").isNotNull(), F.concat(head, F.regexp_replace("_part", f"^{marker}", ""))).otherwise(F.col("_part"))
    texts = filled.groupBy(doc, "section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p")))), lambda x: x["p"]), "").alias("_text"))
    attributes = F.concat(F.lit('<section id="'), quoted("section_id"), F.lit('" number="'), quoted("number"), F.lit('" title="'), quoted("title"), F.lit('" pages="'), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit('">\n'))
    shown = wanted.join(texts, [doc, "section_id"], "left").select(doc, "section_id", order, F.concat(attributes, F.coalesce("_text", F.lit("")), F.lit("\n</section>")).alias("_shown"))
    listed = chosen.select("topic", doc, "section_id").distinct().join(shown, [doc, "section_id"]).groupBy(doc, "topic").agg(F.array_sort(F.collect_list(F.struct(order, "_shown"))).alias("_all"))
    return listed.select(doc, "topic", F.array_join(F.transform("_all", lambda x: x["_shown"]), "\n\n").alias("text"))


def other_releases(runs: DataFrame, version: str, current: str) -> DataFrame:
    """Runs that are pinned to another terminology release than the current one, which may not be mixed in; unpinned runs may go on."""
    return runs.where(F.col(version).isNotNull() & (F.col(version) != current))


def rows_written(cells: DataFrame, book: list[str], sheet: str, row: str) -> DataFrame:
    """Rows with a filled cell, by sheet."""
    return cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*book, sheet).agg(F.countDistinct(row).alias("rows"))


def header_spans(headers: DataFrame, sheet: list[str], column: str, text: str) -> DataFrame:
    """*sheet, text, first and last column of the runs of equal neighbouring header cells."""
    w = Window.partitionBy(*sheet).orderBy(column)
    turned = F.when(F.lag(text).over(w).eqNullSafe(F.col(text)) & (F.lag(column).over(w) == F.col(column) - 1), 0).otherwise(1)
    runs = headers.withColumn("_new", turned).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*sheet, "_run").agg(F.first(text).alias(text), F.min(column).alias("first"), F.max(column).alias("last")).drop("_run")


def recall_with_outside(tallies: DataFrame, outside: DataFrame, by: list[str]) -> DataFrame:
    """*by, gold, outside, matched and recall, which counts what is outside the model as gold that nothing matched; null where there is nothing."""
    sums = tallies.groupBy(*by).agg(F.sum("gold").alias("gold"), F.sum("matched").alias("matched"))
    out = outside.groupBy(*by).agg(F.sum("n").alias("outside"))
    both = sums.join(out, by, "full").fillna(0, ["gold", "matched", "outside"])
    return both.withColumn("recall", F.round(F.col("matched") / F.nullif(F.col("gold") + F.col("outside"), F.lit(0)), 4))


def not_scored(layout: DataFrame, books: DataFrame, gold: DataFrame, book: str, sheet: str) -> DataFrame:
    """The layout's sheets that a book's gold side lacks: listed, not scored. The layout is a short table of sheets."""
    sheets = layout.select(sheet).distinct()
    every = books.select(book).distinct().crossJoin(F.broadcast(sheets))
    return every.join(gold.select(book, sheet).distinct(), [book, sheet], "left_anti")
