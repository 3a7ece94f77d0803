"""Quotes, looked for in the section that they cite and, failing that, in the other sections of their document."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import best_window
from ..session import importable, saved

# Markers in section texts; numbers and negations, in which a quote and its place must agree; bounds of a near match
# (characters, score) and of confidence.
MARKER = r"\[\[(?:PAGE [0-9]+|TABLE [^\]]+)\]\]"
NUMBER, NEGATION = r"\d+(?:[.,]\d+)?", r"\b(?:no|not|non|without|never|except|excluding)\b"
NEAR_LENGTH, NEAR_SCORE = 20, 90.0
NOT_FOUND, NO_QUOTE, NOT_VERBATIM = 0.3, 0.6, 0.5
WAYS = ("exact", "compact", "near")


def fold(text: Column) -> Column:
    """White space of any kind as one space, trimmed, lower case."""
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def searchable(sections: DataFrame, doc: str, section: str, page: str, text: str, tables: DataFrame | None = None) -> DataFrame:
    """doc, section, hay (the folded text that quotes are looked for in) and breaks (start, page) of every section.

    A text's [[PAGE n]] markers turn the page, which starts as `page`, and are dropped; [[TABLE id]] markers give way to the
    rows of that table of the document, on the table's own page. tables: doc, table_id, table_page, cells (array of rows). breaks has, in
    order, where each piece starts in hay, in characters. A null text is empty; unknown tables give nothing.
    """
    piece = F.posexplode(F.split(F.coalesce(text, F.lit("")), f"(?={MARKER})")).alias("_at", "_piece")
    cut = sections.select(doc, section, F.col(page).cast("long").alias("_first"), piece)
    number = lambda kind, what: F.nullif(F.regexp_extract("_piece", rf"^\[\[{kind} ({what})\]\]", 1), F.lit(""))
    so_far = Window.partitionBy(doc, section).orderBy("_at")
    turned = F.last(F.expr(r"try_cast(nullif(regexp_extract(_piece, '^\\[\\[PAGE ([0-9]+)\\]\\]', 1), '') as long)"), ignorenulls=True).over(so_far)
    cut = cut.select(doc, section, "_at", F.coalesce(turned, "_first").alias("_page"), number("TABLE", r"[^\]]+").alias("_table"), F.regexp_replace("_piece", f"^{MARKER}", "").alias("_text"))
    parts = cut.select(doc, section, "_at", F.lit(1 << 30).alias("_row"), "_page", "_text")
    if tables is not None:
        rows = tables.select(F.col(doc), F.col("table_id").alias("_table"), F.col("table_page").cast("long").alias("_page"), F.posexplode("cells").alias("_row", "_cells"))
        line = F.array_join(F.filter("_cells", lambda c: c.isNotNull() & (c != "")), " ")
        inside = cut.where("_table is not null").drop("_page", "_text").join(rows, [doc, "_table"])
        parts = parts.unionByName(inside.select(doc, section, "_at", "_row", "_page", line.alias("_text")))
    parts = parts.withColumn("_text", fold(F.col("_text")))
    width = F.when(F.col("_text") != "", F.char_length("_text") + 1).otherwise(0)
    before = Window.partitionBy(doc, section).orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)))
    kept = F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct("_at", "_row", "start", F.col("_page").alias("page"), "_text"))))
    whole = parts.groupBy(doc, section).agg(kept.alias("_all"))
    return whole.select(
        doc, section, F.array_join(F.transform("_all", lambda x: x["_text"]), " ").alias("hay"), F.transform("_all", lambda x: F.struct(x["start"].alias("start"), x["page"].alias("page"))).alias("breaks")
    )


def find_exact(needle: str, hay: str) -> int:
    """First place of needle that no letter, digit or underscore touches where the needle has a letter or digit at that end; -1: none."""
    word = lambda c: c.isalnum() or c == "_"
    at = hay.find(needle)
    while at >= 0:
        end = at + len(needle)
        if not (needle[0].isalnum() and at and word(hay[at - 1])) and not (needle[-1].isalnum() and end < len(hay) and word(hay[end])):
            return at
        at = hay.find(needle, at + 1)
    return -1


def find_compact(needle: str, hay: str) -> int:
    """The same with spaces left out on both sides; borders are judged in hay as it stands. Only for quotes with a digit or three words."""
    if not any(c.isdigit() for c in needle) and needle.count(" ") < 2:
        return -1
    places = np.flatnonzero(np.array([c != " " for c in hay], bool))
    short, dense = needle.replace(" ", ""), hay.replace(" ", "")
    at = dense.find(short)
    while at >= 0:
        first, last = int(places[at]), int(places[at + len(short) - 1]) + 1
        if not (first and hay[first - 1].isalnum() and needle[0].isalnum()) and not (last < len(hay) and hay[last].isalnum() and needle[-1].isalnum()):
            return first
        at = dense.find(short, at + 1)
    return -1


def find_near(needle: str, hay: str) -> int:
    """Begin of the best stretch for long quotes, if it begins a word and has the quote's numbers and negations; -1: none."""
    if len(needle) < NEAR_LENGTH:
        return -1
    found = best_window(needle, hay, NEAR_SCORE)
    if not found or (found[0] and hay[found[0] - 1].isalnum()):
        return -1
    stretch = hay[found[0] : found[1]]
    return found[0] if all(re.findall(p, needle) == re.findall(p, stretch) for p in (NUMBER, NEGATION)) else -1


_FINDERS = {"exact": find_exact, "compact": find_compact, "near": find_near}


def place(needle: str, hay: str, ways: tuple[str, ...] = WAYS) -> int:
    """Where hay holds needle, both folded, by the first way that finds it; -1: nowhere."""
    return next((at for at in (_FINDERS[w](needle, hay) for w in ways if needle) if at >= 0), -1)


def _place_of(ways: tuple[str, ...]):
    @F.pandas_udf(T.LongType())
    def places(needle: pd.Series, hay: pd.Series) -> pd.Series:
        return pd.Series([place(a, b, ways) for a, b in zip(needle, hay, strict=True)], dtype="int64")

    return places


def _may_hold(needle: Column, hay: Column, ways: tuple[str, ...]) -> Column:
    """What every section fulfils that holds the needle: it has its characters without spaces, or, for a near match,
    all its numbers and one of the pieces that as many edits as are allowed leave whole."""
    dense = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    inside = F.contains(dense(hay), dense(needle))
    if "near" not in ways:
        return inside
    pieces = F.floor(F.char_length(needle) * 0.2).cast("int") + 1
    size = F.floor(F.char_length(needle) / pieces).cast("int")
    whole = F.exists(F.sequence(F.lit(0), pieces - 1), lambda i: F.contains(hay, needle.substr(i * size + 1, size)))
    numbers = F.forall(F.regexp_extract_all(needle, F.lit(f"(?U)({NUMBER})"), F.lit(1)), lambda x: F.contains(hay, x))
    return inside | ((F.char_length(needle) >= NEAR_LENGTH) & numbers & whole)


def located(quotes: DataFrame, key: list[str], doc: str, quote: str, cited: str, sections: DataFrame, section: str, pos: str, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """Every quote with found_in and page: the cited section, else the first other one of its document, that holds it; null where none does.

    sections: doc, section, pos (their order), hay and breaks of `searchable`. key names a quote's row. A bar between cells of a table counts as
    a space. Each quote first meets the section that it cites; only what is not there meets the document's others, and Python sees those
    pairs only that pass what SQL can rule out. Null and blank quotes are found nowhere.
    """
    importable(quotes.sparkSession)
    asked = quotes.withColumn("_needle", fold(F.replace(F.col(quote), F.lit("|"), F.lit(" "))))
    texts = sections.select(F.col(doc).alias("_doc"), F.col(section).alias("_in"), F.col(pos).alias("_pos"), "hay", "breaks")
    needles = asked.where("_needle <> ''").select(*key, F.col(doc), F.col(cited).alias("_cited"), "_needle")
    finder = _place_of(tuple(ways))

    def found(pairs: DataFrame) -> DataFrame:
        at = pairs.where(_may_hold(F.col("_needle"), F.col("hay"), ways)).withColumn("_at", finder("_needle", "hay")).where("_at >= 0")
        page = F.try_element_at(F.filter("breaks", lambda b: b["start"] <= F.col("_at")), F.lit(-1))["page"]
        return at.select(*key, "_pos", F.col("_in").alias("found_in"), page.alias("page"))

    same = F.col(doc) == F.col("_doc")
    own = saved(found(needles.join(texts, same & (F.col("_cited") == F.col("_in")))).drop("_pos"))
    left = needles.join(own, key, "left_anti")
    others = found(left.join(texts, same & ~F.col("_cited").eqNullSafe(F.col("_in"))))
    first = others.groupBy(*key).agg(F.min_by(F.struct("found_in", "page"), "_pos").alias("_f")).select(*key, "_f.found_in", "_f.page")
    return quotes.join(own.unionByName(first), key, "left")


def provenance(cited: DataFrame, key: list[str], doc: str, quote: str, section: str, confidence: str, sections: DataFrame, pos: str, tables: DataFrame | None = None, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """cited with source_section, source_page, confidence, verified and note.

    sections as in `located`, with the same column names for document and section; tables: doc, table_id, owner (the section that a table is
    in): who cites a table cites its section. Found quotes keep their confidence, between 0 and 1, and name the section where they are, with a note if that is
    not the cited one; others get at most NOT_FOUND, and values without a quote at most NO_QUOTE. Both keep the cited section if the
    document has it, else null. Null confidence counts as 0.
    """
    rows = cited.withColumn("_said", F.col(section))
    if tables is not None:
        owners = tables.select(F.col(doc), F.col("table_id").alias(section), F.col("owner").alias("_owner"))
        known = sections.select(F.col(doc), F.col(section).alias("_owner")).distinct()
        owners = owners.join(known, [doc, "_owner"])
        rows = rows.join(owners, [doc, section], "left").withColumn("_said", F.coalesce("_owner", section)).drop("_owner")
    ids = sections.select(F.col(doc), F.col(section).alias("_said"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(ids, [doc, "_said"], "left")
    placed = located(rows, key, doc, quote, "_said", sections, section, pos, ways)
    given, bare = F.least(F.greatest(F.coalesce(F.col(confidence), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.coalesce(quote, F.lit("")) == ""
    sure, here = F.col("found_in").isNotNull(), F.when(F.col("_known"), F.col("_said"))
    moved = F.concat(F.lit("quote found in "), F.col("found_in").cast("string"), F.lit(", not the cited "), F.coalesce(F.col("_said").cast("string"), F.lit("none")))
    note = F.when(bare, "no supporting quote was given").when(~sure, "quote not found in the document; the value may not be supported").when(~F.col("found_in").eqNullSafe(F.col("_said")), moved)
    level = F.when(bare, F.least(given, F.lit(NO_QUOTE))).when(~sure, F.least(given, F.lit(NOT_FOUND))).otherwise(given)
    columns = [c for c in cited.columns if c != confidence]
    return placed.select(*columns, F.coalesce("found_in", here).alias("source_section"), F.col("page").alias("source_page"), level.alias(confidence), sure.alias("verified"), note.alias("note"))


def verbatim(values: DataFrame, key: list[str], doc: str, value: str, section: str, confidence: str, sections: DataFrame, ways: tuple[str, ...] = WAYS) -> DataFrame:
    """values whose text should stand in their section as it is: where it does not, confidence is NOT_VERBATIM at most and verbatim false.

    Values without a known section are left as they are (verbatim null).
    """
    importable(values.sparkSession)
    needles = values.withColumn("_needle", fold(F.replace(F.col(value), F.lit("|"), F.lit(" ")))).select(*key, F.col(doc), F.col(section), "_needle")
    at = needles.join(sections.select(doc, section, "hay"), [doc, section]).select(*key, (_place_of(tuple(ways))(F.coalesce("_needle", F.lit("")), F.col("hay")) >= 0).alias("verbatim"))
    out = values.join(at, key, "left")
    return out.withColumn(confidence, F.when(~F.col("verbatim"), F.least(F.col(confidence), F.lit(NOT_VERBATIM))).otherwise(F.col(confidence)))


def review_reasons(confidence: Column, verified: Column, status: Column, least: float) -> Column:
    """Why a value should be looked at, in order: confidence below the threshold, source not verified, terminology not exact; nulls say nothing."""
    number = lambda c: F.format_string("%.2f", c)
    return F.array_compact(
        F.array(
            F.when(confidence < least, F.concat(F.lit("confidence "), number(confidence), F.lit(" below "), number(F.lit(least)))),
            F.when(~verified, F.lit("source not verified")),
            F.when(status != "exact", F.concat(F.lit("terminology "), status)),
        )
    )


def flat_provenance(records: DataFrame, key: list[str], fields: list[str], least: float = 0.7) -> DataFrame:
    """One row per value of wide records: *key, field, value, confidence, verified, status, reasons and needs_review.

    Each of `fields` is a struct of value, confidence, verified and status. Values that are empty and have no confidence give no row; a value
    without provenance was derived: confidence 1, not verified, nothing to review but its terminology.
    """
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), *(F.col(f)[c].alias(c) for c in ("value", "confidence", "verified", "status"))) for f in fields))).alias("_v")
    rows = records.select(*key, each).select(*key, "_v.*").where("coalesce(value, '') <> '' or confidence is not null")
    reasons = review_reasons(F.col("confidence"), F.when(F.col("confidence").isNotNull(), F.col("verified")), F.col("status"), least)
    return rows.withColumn("reasons", reasons).withColumns(
        {"needs_review": F.size("reasons") > 0, "verified": F.coalesce("verified", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(1.0))}
    )
