"""Visual rows of pages, heading candidates, the best numbered outline, bookmarks and section names."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import partial_ratio, ratio
from ..functions.text import plausible_title, title_key
from ..session import importable, saved

# What numbered and appendix headings look like, which bookmarks and how far a chain may jump.
NUMBERED = r"(?d)^(\d{1,2}(?:\.\d{1,3}){0,5})\.?\s+(\S.*)$"
APPENDIX = r"(?iU)^((?:protocol\s+)?(?:appendix|attachment|annex))\s+([A-Z0-9]{1,6}(?:[.\-][A-Z0-9]{1,6}){0,3})\.?\s*[^\w\s(]?\s*(.*)$"
SKIPPED = r"(?i)^(table|figure|listing|exhibit)\s*[\w.\-]*\d|^(table of contents|contents|list of )"
GAP = 3


def visual_rows(fragments: DataFrame, page: list[str]) -> DataFrame:
    """Fragments that share a base line as one row: *page, idx, text, x0, y0, x1, y1, size, bold.

    fragments: text, x0, y0, x1, y1, size and bold (the share of bold characters), by rounded top and left edge.
    One goes with the fragment before it if they overlap vertically by 0.6 of the lower one's height. A row's text is in order
    of left edges, its size and boldness (0.6 or more) weighted by characters.
    """
    order = [F.rint("y0"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("text")]
    w = Window.partitionBy(*page).orderBy(*order)
    height = F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(w) - F.lag("y0").over(w))
    overlap = F.least(F.col("y1"), F.lag("y1").over(w)) - F.greatest(F.col("y0"), F.lag("y0").over(w))
    joins = F.coalesce(F.lag("y1").over(w).isNotNull() & (overlap >= 0.6 * F.when(height == 0, 1.0).otherwise(height)), F.lit(False))
    cut = fragments.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_at", F.row_number().over(w))
    cut = cut.withColumn("idx", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    chars = F.greatest(F.char_length("text"), F.lit(1))
    weigh = lambda c: F.sum(F.col(c) * chars) / F.sum(chars)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "_at", "text"))), lambda f: f["text"]), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return cut.groupBy(*page, "idx").agg(text.alias("text"), *box, F.round(weigh("size"), 2).alias("size"), (weigh("bold") >= 0.6).alias("bold"))


def outside_tables(lines: DataFrame, page: list[str], tables: DataFrame, tolerance: float = 2.0, cell: float = 100.0) -> DataFrame:
    """Lines whose centre is in no table of their page, tables being wider by `tolerance` on each side.

    Lines and tables (both with x0, y0, x1, y1) meet by page and square of `cell` points, so that a page full of both makes no product
    of the two. Lines without a box stay.
    """
    keyed = lines.withColumns({"_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("y0") + F.col("y1")) / 2})
    keyed = keyed.withColumns({"_gx": F.floor(F.col("_x") / cell), "_gy": F.floor(F.col("_y") / cell)})
    squares = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - tolerance) / cell), F.floor((F.col(high) + tolerance) / cell)))
    sound = tables.where(f"x1 + {2 * tolerance} >= x0 and y1 + {2 * tolerance} >= y0")
    areas = sound.select(*page, *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), squares("x0", "x1").alias("_gx")).withColumn("_gy", squares("_y0", "_y1"))
    k, t = keyed.alias("k"), areas.alias("t")
    same = [F.col(f"k.{c}") == F.col(f"t.{c}") for c in [*page, "_gx", "_gy"]]
    within = F.col("_x").between(F.col("_x0") - tolerance, F.col("_x1") + tolerance) & F.col("_y").between(F.col("_y0") - tolerance, F.col("_y1") + tolerance)
    on = within
    for s in same:
        on &= s
    return k.join(t, on, "left_anti").select(*lines.columns)


def _following(lines: DataFrame, doc: str, page: str, edge: Column) -> tuple[DataFrame, Column]:
    """lines with _one and _two (whether the next two lines go on with a heading that begins here), and the text with them."""
    w = Window.partitionBy(doc, page).orderBy("idx")
    part = F.struct("text", "x0", "y0", "x1", "y1", "size", "bold")
    rows = lines.withColumns({"_n1": F.lead(part, 1).over(w), "_n2": F.lead(part, 2).over(w)})
    reaches = lambda x0, x1: x1 >= edge - 0.18 * (edge - x0)
    goes_on = lambda n, y0, y1: (
        n.isNotNull() & (n["bold"] == F.col("bold")) & (F.abs(n["size"] - F.col("size")) < 0.6) & (n["y0"] - y1 <= 0.8 * (y1 - y0)) & ~n["text"].rlike(NUMBERED)
    )
    one = F.coalesce(reaches(F.col("x0"), F.col("x1")) & goes_on(F.col("_n1"), F.col("y0"), F.col("y1")), F.lit(False))
    two = F.coalesce(reaches(F.col("_n1.x0"), F.col("_n1.x1")) & goes_on(F.col("_n2"), F.col("_n1.y0"), F.col("_n1.y1")), F.lit(False))
    rows = rows.withColumn("_one", one).withColumn("_two", F.col("_one") & two)
    return rows, F.concat_ws(" ", F.when(F.col("_one"), F.col("_n1.text")), F.when(F.col("_two"), F.col("_n2.text")))


def _styled() -> Column:
    return F.col("bold") | (F.col("size") >= F.col("body") + 1.5)


def _taken() -> Column:
    return F.when(F.col("_two"), 2).when(F.col("_one"), 1).otherwise(0)


def numbered_candidates(lines: DataFrame, doc: str, page: str, most: int | None = 99) -> DataFrame:
    """doc, page, idx, y0, title, number, level, weight and extra (further lines taken) of the lines that may be numbered headings.

    lines: idx (order in the page), text, x0, y0, x1, y1, size, bold, body (the document's size) and edge (where the page's lines end).
    A heading that reaches the edge goes on in up to two lines of its style. Chapters are 1 to 30, other numbers up to `most` (null: any).
    """
    rows, more = _following(lines, doc, page, F.col("edge"))
    found = rows.where(F.col("text").rlike(NUMBERED) & _styled())
    parts = F.transform(F.split(F.regexp_extract("text", NUMBERED, 1), r"\."), lambda p: p.try_cast("int"))
    title = F.concat_ws(" ", F.trim(F.regexp_extract("text", NUMBERED, 2)), F.nullif(more, F.lit("")))
    found = found.withColumns({"_parts": parts, "title": title})
    found = found.where((F.get("_parts", F.lit(0)).between(1, 30)) & plausible_title(F.col("title")))
    if most is not None:
        found = found.where(~F.exists("_parts", lambda p: p > most))
    weight = 1.0 + F.when(F.col("size") >= F.col("body") + 1.5, 1.0).otherwise(0.0) + F.when(F.col("bold"), 0.5).otherwise(0.0)
    number = F.array_join(F.transform("_parts", lambda p: p.cast("string")), ".")
    return found.select(doc, page, "idx", "y0", "title", number.alias("number"), F.size("_parts").alias("level"), weight.alias("weight"), _taken().alias("extra"))


def appendix_candidates(lines: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, page, idx, y0, title, appendix (its identifier) and extra of the lines that may open an appendix; those without a title take it from below."""
    rows, more = _following(lines, doc, page, F.lit(0.0))
    found = rows.where(F.col("text").rlike(APPENDIX) & _styled() & (F.char_length("text") <= 160))
    part = lambda n: F.trim(F.regexp_extract("text", APPENDIX, n))
    found = found.withColumns({"_own": part(3), "_label": F.concat(F.initcap(part(1)), F.lit(" "), part(2)), "_key": F.upper(part(2))})
    title = F.when(F.col("_own") != "", F.col("_own")).otherwise(more)
    shown = F.when(title != "", F.expr("1 = 1")).otherwise(F.lit(False))
    whole = F.when(shown, F.regexp_replace(F.concat("_label", F.lit(". "), title), "^[ .]+|[ .]+$", "")).otherwise(F.col("_label"))
    return found.select(doc, page, "idx", "y0", whole.alias("title"), F.col("_key").alias("appendix"), F.when(F.col("_own") == "", _taken()).otherwise(0).alias("extra"))


def front_candidates(lines: DataFrame, doc: str, page: str, width: str) -> DataFrame:
    """doc, page, idx, y0, title and extra of bold unnumbered lines that are in capitals, centred or large; lines that one has taken are none themselves."""
    rows, more = _following(lines, doc, page, F.lit(0.0))
    letters, capitals = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"\p{Lu}"))
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col(width) / 2) < 0.08 * F.col(width)
    looks = (capitals >= 0.85 * letters) | centred | (F.col("size") >= F.col("body") + 2.5)
    fit = F.col("bold") & (F.col("size") >= F.col("body") - 0.5) & F.char_length("text").between(4, 90) & ~F.endswith("text", F.lit(":")) & ~F.col("text").rlike(NUMBERED) & (letters >= 4) & looks
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(doc, page).orderBy("idx")))
    found = rows.where(fit).select(doc, page, "idx", "y0", F.concat_ws(" ", "text", F.nullif(more, F.lit(""))).alias("title"), _taken().alias("extra"), "_nth")
    # a page's few candidates from the top: each is one unless the last one took it
    ordered = F.array_sort(F.collect_list(F.struct("_nth", "idx", "y0", "title", "extra")))
    start = F.expr("named_struct('next', 0, 'kept', cast(array() as array<int>))")
    step = lambda s, x: F.when(x["_nth"] < s["next"], s).otherwise(F.struct((x["_nth"] + x["extra"] + 1).alias("next"), F.concat(s["kept"], F.array(x["_nth"])).alias("kept")))
    pages = found.groupBy(doc, page).agg(ordered.alias("_all")).withColumn("_kept", F.aggregate("_all", start, step)["kept"])
    return pages.select(doc, page, F.explode(F.filter("_all", lambda x: F.array_contains(F.col("_kept"), x["_nth"]))).alias("h")).select(doc, page, "h.idx", "h.y0", "h.title", "h.extra")


def may_start(number: tuple[int, ...]) -> bool:
    return number[0] <= GAP and all(p <= 2 for p in number[1:])


def predecessors(number: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], bool]]:
    """What may stand before a number in an outline: (number, False) itself, or (prefix, True) any number that begins so.

    Before a child stands its parent, or, where levels were missed, an ancestor; before a sibling at any depth the ones up to GAP
    before it with all that is below them. Levels that open on the way start at 1 or 2.
    """
    if len(number) > 1 and 1 <= number[-1] <= GAP:
        yield number[:-1], False
    for depth in range(len(number) - 2, 0, -1):
        if all(p <= 2 for p in number[depth:]):
            yield number[:depth], False
    for depth in range(1, len(number) + 1):
        if all(p <= 2 for p in number[depth:]):
            for gap in range(1, GAP + 1):
                yield (*number[: depth - 1], number[depth - 1] - gap), True


def best_chain(numbers: list[tuple[int, ...]], weights: list[float]) -> list[bool]:
    """Which candidates make up the heaviest subsequence that is an outline; of equal ones that whose members come first.

    The best chain that ends in a number, and in any number of a prefix, is all that a later candidate can build on, so each looks at a
    few entries and not at all that went before.
    """
    exact: dict[tuple[int, ...], tuple[float, int]] = {}
    under: dict[tuple[int, ...], tuple[float, int]] = {}
    total, back = [], []
    for i, (number, weight) in enumerate(zip(numbers, weights, strict=True)):
        before = [x for p, prefix in predecessors(number) if (x := (under if prefix else exact).get(p))]
        best = max(before, key=lambda x: (x[0], -x[1]), default=None)
        alone = weight if may_start(number) else float("-inf")
        use = best is not None and best[0] + weight > alone
        total.append(best[0] + weight if use else alone)
        back.append(best[1] if use else -1)
        if total[i] > float("-inf"):
            for table, keys in ((exact, [number]), (under, [number[:k] for k in range(1, len(number) + 1)])):
                for k in keys:
                    if k not in table or total[i] > table[k][0]:
                        table[k] = (total[i], i)
    kept = [False] * len(numbers)
    k = max(range(len(numbers)), key=total.__getitem__, default=-1)
    if k >= 0 and total[k] == float("-inf"):
        k = -1
    while k >= 0:
        kept[k], k = True, back[k]
    return kept


def outline_chain(candidates: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """candidates (number as text, weight, ...) with kept: whether the document's heaviest outline has them. Only keys, numbers and weights of a document meet in a task."""
    importable(candidates.sparkSession)
    keys = [doc, *order]
    thin = candidates.select(*keys, "number", "weight")
    schema = thin.select(*keys).schema.add("kept", "boolean", False)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in [*order, "number"]])
        numbers = [tuple(map(int, n.split("."))) for n in table["number"].to_pylist()]
        return table.select(keys).append_column("kept", pa.array(best_chain(numbers, table["weight"].to_pylist())))

    return candidates.join(thin.groupBy(doc).applyInArrow(run, schema), keys)


def detected(lines: DataFrame, doc: str, page: str, width: str, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings (doc, page, idx, y0, title, number, appendix, level, kind, weight, extra) of documents, and the rejected numbered ones.

    lines as in `numbered_candidates` with the page's width; contents: doc and page of contents pages, which hold no headings. Numbered lines
    behind the first appendix (behind the first number) are the appendix's. Front matter stands before the first chapter and not on page 1,
    and is not the title page's text again. Unnumbered headings that repeat the last one on its page or the next go.
    """
    importable(lines.sparkSession)
    body = saved(lines.join(contents, [doc, page], "left_anti"))
    place = F.struct(F.col(page).alias("p"), F.col("y0").alias("y"))
    numbered, appendices = numbered_candidates(body, doc, page), saved(appendix_candidates(body, doc, page))
    numbered = saved(numbered)
    first = numbered.groupBy(doc).agg(F.min(place).alias("_first"))
    behind = appendices.join(first, doc).where(place > F.col("_first")).groupBy(doc).agg(F.min(place).alias("_limit"))
    chained = saved(outline_chain(numbered.join(behind, doc, "left").where(F.col("_limit").isNull() | (place < F.col("_limit"))).drop("_limit"), doc, [page, "y0", "idx"]))
    kept = chained.where("kept").drop("kept")
    chapters = kept.where("level = 1").groupBy(doc).agg(F.min(place).alias("_body"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    titles = lines.where(F.col(page) == 1).groupBy(doc).agg(title_key(words).alias("_cover"))
    front = front_candidates(body.where(F.col(page) > 1), doc, page, width).join(chapters, doc, "left").where(F.col("_body").isNull() | (place < F.col("_body"))).drop("_body")
    front = front.join(appendices.select(doc, page, "idx"), [doc, page, "idx"], "left_anti").join(titles, doc, "left").withColumn("_bare", title_key(F.col("title")))
    again = (F.char_length("_bare") >= 20) & F.col("_cover").isNotNull()
    front = front.where(~again).unionByName(front.where(again).where(partial_ratio("_bare", "_cover") < 90)).drop("_bare", "_cover")
    none = F.lit(None).cast("string")
    every = kept.withColumns({"appendix": none, "kind": F.lit("body")}).unionByName(
        appendices.withColumns({"number": none, "level": F.lit(1), "weight": F.lit(2.0), "kind": F.lit("appendix")})
    ).unionByName(front.withColumns({"number": none, "appendix": none, "level": F.lit(1), "weight": F.lit(1.0), "kind": F.lit("front")}))
    return without_continuations(every, [doc], [page, "y0", "idx"], "title", page, "number", "appendix"), chained.where("not kept").drop("kept")


def without_continuations(headings: DataFrame, within: list[str], order: list[str], title: str, page: str, number: str | None = None, appendix: str | None = None) -> DataFrame:
    """Headings but the unnumbered ones that repeat the last heading kept, on its page or the next.

    They repeat it if their titles are equal as words, or their appendix is the same. What was dropped is not compared with, so a
    title on the pages 1, 2 and 3 is kept on 1 and 3. A group's keys go through one fold in order, which carries the last one kept.
    """
    none = F.lit(None).cast("string")
    mark = F.struct(*order, F.col(page).cast("long").alias("_p"), title_key(F.col(title)).alias("_t"), (F.col(number) if number else none).alias("_n"), (F.col(appendix) if appendix else none).alias("_a"))
    marked = headings.withColumn("_m", mark)
    groups = marked.groupBy(*within).agg(F.array_sort(F.collect_list("_m")).alias("_all"))
    kind = groups.schema["_all"].dataType.elementType.simpleString()
    start = F.expr(f"named_struct('last', cast(null as {kind}), 'kept', cast(array() as array<{kind}>))")

    def step(s: Column, x: Column) -> Column:
        last = s["last"]
        same = F.coalesce(x["_a"] == last["_a"], F.lit(False)) | (x["_t"] == last["_t"])
        again = last.isNotNull() & x["_n"].isNull() & x["_p"].isin(last["_p"], last["_p"] + 1) & same
        return F.when(F.coalesce(again, F.lit(False)), s).otherwise(F.struct(x.alias("last"), F.concat(s["kept"], F.array(x)).alias("kept")))

    kept = groups.select(*within, F.explode(F.array_distinct(F.aggregate("_all", start, step)["kept"])).alias("_m"))
    return marked.join(kept, [*within, "_m"], "left_semi").drop("_m")


def reconciled(bookmarks: DataFrame, headings: DataFrame, lines: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Every bookmark with what it says about headings: doc, pos, number, bare, state, and idx, y0 and heading_page of the heading or line.

    bookmarks: doc, pos (order), title, page; headings: doc, page, idx, y0, title, number; lines: doc, page, idx, y0, text; pages: doc and n_pages.
    state is `skipped` (tables, figures, contents, pages that are not there), `matched` (the first heading at most a page away with the same number and
    similar in part, 80 or more, or, without a number, similar as a whole, 85), `repeats` (matches a heading added by the bookmark at
    added_by), `added` (a heading that was missed: the page's first line that holds the title, 92, or a numbered one at the
    top of its page), or `lost`. Bookmarks meet headings and lines by document and page, never all.
    """
    importable(bookmarks.sparkSession)
    number = r"^(\d{1,2}(?:\.\d{1,3}){0,5})\.?\s+(.*)$"
    marks = bookmarks.join(pages, doc).withColumns(
        {"number": F.nullif(F.regexp_extract("title", number, 1), F.lit("")), "bare": F.trim(F.when(F.col("title").rlike(number), F.regexp_extract("title", number, 2)).otherwise(F.col("title")))}
    )
    marks = saved(marks.withColumns({"_bare": title_key(F.col("bare")), "_skip": F.col("title").rlike(SKIPPED) | ~F.col(page).between(1, F.col("n_pages"))}))
    asked = marks.where("not _skip").select(doc, "pos", F.col(page).alias("_own"), "number", "_bare", F.explode(F.sequence(F.col(page) - 1, F.col(page) + 1)).alias(page))

    def agreeing(others: DataFrame) -> DataFrame:
        """others (doc, page, _title, _number, ...) that the bookmarks agree with."""
        pairs = asked.join(others, [doc, page])
        by_number = pairs.where("number = _number").where(partial_ratio("_title", "_bare") >= 80)
        return by_number.unionByName(pairs.where("number is null").where(ratio("_title", "_bare") >= 85))

    heads = headings.select(doc, page, F.struct(F.col(page).alias("p"), "y0", "idx").alias("_h"), title_key(F.col("title")).alias("_title"), F.col("number").alias("_number"))
    hits = saved(agreeing(heads).groupBy(doc, "pos").agg(F.min("_h").alias("_h")))
    left = saved(marks.where("not _skip").join(hits, [doc, "pos"], "left_anti"))
    near = left.select(doc, "pos", page, "_bare").join(lines.where(F.char_length("text") < 170).select(doc, page, F.col("idx").alias("_i"), F.col("y0").alias("_y"), title_key(F.col("text")).alias("_line")), [doc, page])
    rows = saved(near.where(partial_ratio("_bare", "_line") >= 92).groupBy(doc, "pos").agg(F.min(F.struct("_i", "_y")).alias("_row")))
    left = saved(left.join(rows, [doc, "pos"], "left"))
    possible = left.where("number is not null or _row is not null")
    earlier = possible.select(doc, page, F.col("pos").alias("_earlier"), F.col("_bare").alias("_title"), F.col("number").alias("_number"))
    linked = agreeing(earlier).where("_earlier < pos").groupBy(doc, "pos").agg(F.array_sort(F.collect_set("_earlier")).alias("_before"))
    # in order: a bookmark adds a heading unless one that was added before agrees with it
    mine = left.join(linked, [doc, "pos"], "left").select(doc, "pos", F.coalesce("_before", F.array().cast("array<bigint>")).alias("before"), (F.col("number").isNotNull() | F.col("_row").isNotNull()).alias("can"))
    per = mine.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "before", "can"))).alias("_all"))
    start = F.expr("named_struct('added', cast(array() as array<bigint>), 'said', cast(array() as array<struct<pos:bigint,by:bigint>>))")

    def step(s: Column, x: Column) -> Column:
        by = F.array_min(F.array_intersect(x["before"], s["added"]))
        added = F.when(by.isNull() & x["can"], F.concat(s["added"], F.array(x["pos"].cast("long")))).otherwise(s["added"])
        said = F.struct(x["pos"].cast("long").alias("pos"), F.when(by.isNotNull(), by).when(x["can"], x["pos"].cast("long")).alias("by"))
        return F.struct(added.alias("added"), F.concat(s["said"], F.array(said)).alias("said"))

    told = per.select(doc, F.explode(F.aggregate("_all", start, step)["said"]).alias("s")).select(doc, F.col("s.pos").alias("pos"), F.col("s.by").alias("added_by"))
    out = marks.join(hits, [doc, "pos"], "left").join(rows, [doc, "pos"], "left").join(told, [doc, "pos"], "left")
    state = F.when(F.col("_skip"), "skipped").when(F.col("_h").isNotNull(), "matched").when(F.col("added_by").isNull(), "lost").when(F.col("added_by") < F.col("pos"), "repeats").otherwise("added")
    return out.withColumn("state", state).select(
        doc, "pos", "number", "bare", "state", F.when(F.col("state") == "repeats", F.col("added_by")).alias("added_by"),
        F.when(F.col("state") == "matched", F.col("_h.idx")).when(F.col("state") == "added", F.coalesce("_row._i", F.lit(-1))).alias("idx"),
        F.when(F.col("state") == "matched", F.col("_h.y0")).when(F.col("state") == "added", F.coalesce("_row._y", F.lit(0.0))).alias("y0"),
        F.when(F.col("state") == "matched", F.col("_h.p")).when(F.col("state") == "added", F.col(page)).alias("heading_page"),
    )


def section_ids(headings: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """headings (number, kind, title, ...) with section_id: sec-3.4, app-… or fm-… with the title's words, and -2, -3 where one comes again.

    A repeat takes the first free number: a title that ends like a numbered repeat keeps its name if it comes first.
    """
    slug = F.rtrim(F.substring(F.replace(title_key(F.col("title")), F.lit(" "), F.lit("-")), 1, 40), F.lit("-"))
    named = lambda prefix, other: F.concat(F.lit(prefix), F.coalesce(F.nullif(slug, F.lit("")), F.lit(other)))
    base = F.when(F.col("number").isNotNull(), F.concat(F.lit("sec-"), "number")).when(F.col("kind") == "appendix", named("app-", "appendix")).otherwise(named("fm-", "section"))
    based = headings.withColumns({"_base": base, "_key": F.struct(*order)})
    per = based.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), F.col("_base").alias("base")))).alias("_all"))
    key = per.schema["_all"].dataType.elementType["key"].dataType.simpleString()
    start = F.expr(f"named_struct('used', array('title-page', 'toc'), 'out', cast(array() as array<struct<key:{key},id:string>>))")

    def step(s: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(2), F.size(s["used"]) + 2), lambda n: ~F.array_contains(s["used"], F.concat(x["base"], F.lit("-"), n.cast("string"))))
        name = F.when(F.array_contains(s["used"], x["base"]), F.concat(x["base"], F.lit("-"), F.get(free, F.lit(0)).cast("string"))).otherwise(x["base"])
        return F.struct(F.concat(s["used"], F.array(name)).alias("used"), F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), name.alias("id")))).alias("out"))

    ids = per.select(doc, F.explode(F.aggregate("_all", start, step)["out"]).alias("s")).select(doc, F.col("s.key").alias("_key"), F.col("s.id").alias("section_id"))
    return based.join(ids, [doc, "_key"]).drop("_base", "_key")
