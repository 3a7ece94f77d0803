"""Review of records: issues, cell states, references, names; sheets as rows, grids and back; logs and summaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio, token_set_ratio
from ..functions.text import folded
from ..session import importable, saved, small

from ..functions.text import folded


def missing_names(entities: DataFrame, name: str, active: Column) -> DataFrame:
    """Active entities without a name."""
    return entities.where(active & (F.trim(F.coalesce(F.col(name), F.lit(""))) == ""))


def field_issues(fields: DataFrame, layout: DataFrame, on: list[str], value: str, status: str, confidence: str, verified: str, exempt: Column, low: float = 0.7) -> DataFrame:
    """One row per issue of a field: unknown, required, terminology (blocking), low confidence, unverified (warnings).

    layout says by `on` whether a field is required and coded; a field that it does not have is unknown. Accepted, derived and human fields are exempt
    from the last two.
    """
    both = fields.join(layout.select(*on, "required", "coded"), on, "left")
    empty = F.trim(F.coalesce(F.col(value), F.lit(""))) == ""
    issue = lambda when, kind, blocking: F.when(when, F.struct(F.lit(kind).alias("issue"), F.lit(blocking).alias("blocking")))
    found = F.array_compact(F.array(
        issue(F.col("required").isNull(), "unknown", True),
        issue(F.col("required") & empty, "required", True),
        issue(F.col("coded") & ~empty & (F.coalesce(F.col(status), F.lit("")) != "exact"), "terminology", True),
        issue(~empty & ~exempt & (F.col(confidence) < low), "low confidence", False),
        issue(~empty & ~exempt & ~F.col(verified), "unverified", False),
    ))
    return both.withColumn("_issue", F.explode(found)).select(*fields.columns, "_issue.*")


def structure_issues(rows: DataFrame, cells: DataFrame, layout: DataFrame, sheet: list[str], pos: str) -> DataFrame:
    """*sheet, pos, field, issue and blocking of rows of two-level sheets that break their structure.

    rows: every row; cells: sheet, pos, field, value; layout: the sheet's name (last of `sheet`), field, required, nth (the order) and grp (its group: lead, the leading one, or
    below; null for none). A row with nothing in it is empty (told at the last group's first field); a first row must start the leading group; a required field of a
    group is asked for only in rows in which the group has anything.
    """
    at, kind = [*sheet, pos], sheet[-1]
    shape = layout.select(kind, "field", "required", "nth", F.col("grp"))
    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").join(shape, [kind, "field"])
    has = lambda g: F.max((F.col("grp").eqNullSafe(F.lit(g))).cast("int"))
    state = rows.select(*at).join(filled.groupBy(*at).agg(has("lead").alias("_lead"), has("below").alias("_below"), F.count("*").alias("_n")), at, "left").fillna(0, ["_lead", "_below", "_n"])
    state = state.withColumn("_first", F.row_number().over(Window.partitionBy(*sheet).orderBy(pos)) == 1)
    heads = shape.where("grp is not null").groupBy(kind).agg(F.min_by("field", F.when(F.col("grp") == "lead", F.col("nth"))).alias("_top"), F.min_by("field", F.when(F.col("grp") == "below", F.col("nth"))).alias("_low"))
    told = state.join(heads, kind)
    issue = lambda df, field, name: df.select(*at, F.col(field).alias("field"), F.lit(name).alias("issue"), F.lit(True).alias("blocking"))
    empty = issue(told.where("_n = 0").withColumn("_f", F.coalesce("_low", "_top")), "_f", "empty row")
    start = issue(told.where("_n > 0 and _first and _lead = 0"), "_top", "first row starts no entry")
    asked = state.where("_n > 0").join(shape.where("required"), kind).where("grp is null or (grp = 'lead' and _lead = 1) or (grp = 'below' and _below = 1)")
    lacking = issue(asked.join(filled.select(*at, "field"), [*at, "field"], "left_anti"), "field", "required")
    return empty.unionByName(start).unionByName(lacking)


#: Terms of a tie that are put out at a time.
PIECE = 10_000


def ranked_terms(queries: DataFrame, codelist: str, query: str, terms: DataFrame, code: str, preferred: str, texts: list[str]) -> DataFrame:
    """*queries, code, preferred, score and place of all terms of each query's code list, best first; by preferred term where scores are equal or nothing is asked.

    A term's score is its best text's, and 100 if the query is its code. Distinct queries meet the kinds of terms of their code list only (terms with the same preferred
    term and texts); pairs of texts are scored once. Kinds of a score and preferred term tie: their terms are ranked by code once for each set of kinds
    that ties for any query, so the rows of the result are only joined, not sorted.
    """
    spark = queries.sparkSession
    importable(spark)
    asked = saved(queries.select(codelist, query).distinct().withColumn("_q", folded(F.coalesce(query, F.lit("")))))
    own = terms.select(codelist, code, preferred, F.concat(*(F.coalesce(F.col(c).cast("array<string>") if dict(terms.dtypes)[c].startswith("array") else F.array(F.col(c).cast("string")), F.array().cast("array<string>")) for c in texts)).alias("_all"))
    folds = F.filter(F.transform("_all", lambda t: folded(t)), lambda t: t != "")
    own = own.withColumn("_all", folds).groupBy(codelist, code, preferred).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))).alias("_all"))
    # a term whose code is asked for is a kind of its own
    codes = asked.where("_q <> ''").select(codelist, F.col("_q").alias("_code")).distinct().withColumn("_is", F.lit(True))
    own = own.withColumn("_code", F.lower(F.col(code).cast("string"))).join(codes, [codelist, "_code"], "left").withColumn("_code", F.when(F.col("_is"), F.col("_code"))).drop("_is")
    kind = [codelist, preferred, "_all", "_code"]
    own = saved(own.withColumn("_kind", F.xxhash64(*kind)).select(codelist, code, *kind[1:], "_kind"))
    kinds = saved(own.groupBy("_kind", *kind).agg(F.count("*").alias("_n")).where(F.col(codelist).isNotNull()))
    pairs = asked.join(kinds, codelist).withColumn("_t", F.explode_outer("_all"))
    scores = saved(pairs.where("_q <> '' and _t is not null").select("_q", "_t").distinct()).withColumn("_s", F.round(F.greatest(token_set_ratio("_q", "_t"), ratio("_q", "_t")), 1))
    best = pairs.join(small(saved(scores)), ["_q", "_t"], "left").groupBy(codelist, query, "_q", preferred, "_code", "_kind", "_n").agg(F.max(F.coalesce("_s", F.lit(0.0))).alias("score"))
    best = best.withColumn("score", F.when((F.col("_q") != "") & (F.col("_q") == F.col("_code")), 100.0).otherwise(F.col("score")))
    low = F.lower(F.coalesce(preferred, F.lit(""))).alias("_low")
    ties = best.groupBy(codelist, query, "score", low).agg(F.array_sort(F.collect_list("_kind")).alias("_set"), F.sum("_n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(codelist, query).orderBy(F.desc("score"), "_low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ties = saved(ties.withColumn("_before", before))
    sets = ties.select("_set").distinct().withColumn("_kind", F.explode("_set"))
    ranked = sets.join(own.select("_kind", code, preferred), "_kind").withColumn("_rank", F.row_number().over(Window.partitionBy("_set").orderBy(code)))
    ranked = ranked.select("_set", F.expr(f"(_rank - 1) div {PIECE}").alias("_piece"), "_rank", code, preferred)
    wanted = ties.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {PIECE}"))))
    parts = 4 * spark.sparkContext.defaultParallelism
    out = wanted.repartition(parts, "_set", "_piece").join(ranked.repartition(parts, "_set", "_piece"), ["_set", "_piece"])
    return out.select(codelist, query, code, preferred, "score", (F.col("_before") + F.col("_rank")).cast("int").alias("place"))


def cell_states(fields: DataFrame, value: str, required: Column, unresolved: Column, edited: Column, low: Column, generated: Column) -> DataFrame:
    """fields with the state a reviewer sees first: required, terminology, edited, low, empty, generated or ok."""
    empty = F.trim(F.coalesce(F.col(value), F.lit(""))) == ""
    state = F.when(required & empty, "required").when(~empty & unresolved, "terminology").when(edited, "edited").when(~empty & low, "low")
    return fields.withColumn("state", state.when(empty, "empty").when(generated, "generated").otherwise("ok"))


def import_issues(issues: DataFrame, level: str, message: str, places: list[str], fallback: list[str]) -> DataFrame:
    """kind (error or warning), the message without its details, and where: the filled places, else the fallback's last name parts."""
    where = F.concat_ws(", ", *(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c} "), F.col(c).cast("string"))) for c in places))
    otherwise = F.concat_ws(".", *(F.element_at(F.split(F.col(c), r"\."), -1) for c in fallback))
    return issues.select(
        F.when(F.col(level) == "Error", "error").otherwise("warning").alias("kind"),
        F.split_part(F.col(message), F.lit("\n\nDetails"), F.lit(1)).alias("message"),
        F.when(where != "", where).otherwise(otherwise).alias("location"),
    )


def noted_findings(findings: DataFrame, notes: DataFrame, rule: str, kind: str, by: list[str], most: int = 2000) -> DataFrame:
    """Exact counts per rule with the note's kind (other if there is none); groups beyond `most` are counted in `listed` as `most`."""
    counts = findings.groupBy(*by, rule).agg(F.count("*").alias("n"))
    both = counts.join(notes.select(rule, kind), rule, "left").withColumn(kind, F.coalesce(kind, F.lit("other")))
    return both.withColumn("listed", F.least("n", F.lit(most)))


def unique_names(rows: DataFrame, within: list[str], order: list[str], name: str, out: str = "unique", most: int = 60) -> DataFrame:
    """Each name as it is the first time, case not looked at, then with ` 2`, ` 3`; numbers that other names already bear are passed over."""
    low = F.lower(F.substring(F.col(name), 1, most))
    keyed = rows.withColumns({"_low": low, "_nth": F.row_number().over(Window.partitionBy(*within, low).orderBy(*order))})
    number = F.regexp_extract(low, r"^(.*) ([0-9]{1,9})$", 2)
    taken = keyed.where("_nth = 1").select(*within, F.regexp_extract(low, r"^(.*) ([0-9]{1,9})$", 1).alias("_low"), number.alias("_k")).where("_k <> ''")
    taken = taken.groupBy(*within, "_low").agg(F.collect_set(F.col("_k").cast("int")).alias("_taken"))
    both = keyed.join(taken, [*within, "_low"], "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(2), F.col("_nth") + F.size("_taken") + 1), lambda k: ~F.array_contains(F.col("_taken"), k))
    suffix = F.concat(F.lit(" "), F.get(free, F.col("_nth") - 2).cast("string"))
    made = F.concat(F.rtrim(F.substr(F.col(name), F.lit(1), F.lit(most) - F.length(suffix))), suffix)
    return both.withColumn(out, F.when(F.col("_nth") == 1, F.substring(F.col(name), 1, most)).otherwise(made)).select(*rows.columns, out)


def filled_down(rows: DataFrame, within: list[str], order: list[str], parents: list[str]) -> DataFrame:
    """Continuation rows take the parent values above them."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w) for c in parents})


def listed_twice(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Keys that occur more than once, case not looked at, with their different values."""
    return rows.groupBy(*by, folded(F.col(key)).alias(key)).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(value)).alias("values")).where("n > 1")


def looked_up(rows: DataFrame, key: str, known: DataFrame, known_key: str, value: str) -> DataFrame:
    """rows with the value of their key among the known ones, and `unknown` where a key has none."""
    names = known.groupBy(F.col(known_key).alias(key)).agg(F.min(value).alias(value))
    out = rows.join(names, key, "left")
    return out.withColumn("unknown", F.col(key).isNotNull() & F.col(value).isNull())


def marks_joined(marks: DataFrame, visits: DataFrame, by: list[str], row: str, key: str, pos: str, name: str) -> DataFrame:
    """Per row: the names of its distinct marked visits in visit order, and the keys that no visit has. Unmarked rows have none."""
    known = visits.select(*by, key, pos, name)
    both = marks.select(*by, row, key).distinct().join(known, [*by, key], "left")
    got = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(pos, name))))
    odd = F.array_sort(F.collect_set(F.when(F.col(name).isNull(), F.col(key))))
    out = both.groupBy(*by, row).agg(got.alias("_got"), odd.alias("unknown"))
    return out.select(*by, row, F.array_join(F.transform("_got", lambda x: x[name]), ", ").alias("names"), "unknown")


def marks_of(cells: DataFrame, sheet: list[str], row: str, column: str, text: str, header_row: int = 0, label_column: int = 0) -> DataFrame:
    """A marked grid as rows: label of the row, heads of the columns it marks (an X), in column order; `-` is empty."""
    heads = cells.where((F.col(row) == header_row) & (F.col(column) != label_column)).select(*sheet, column, F.col(text).alias("_head"))
    labels = cells.where((F.col(row) != header_row) & (F.col(column) == label_column)).select(*sheet, row, F.col(text).alias("label"))
    marked = cells.where((F.col(row) != header_row) & (F.upper(F.trim(text)) == "X")).join(heads, [*sheet, column])
    per = marked.groupBy(*sheet, row).agg(F.array_sort(F.collect_list(F.struct(column, "_head"))).alias("_all"))
    out = labels.join(per, [*sheet, row], "left")
    return out.select(*sheet, row, "label", F.array_join(F.transform("_all", lambda x: x["_head"]), ", ").alias("marks"))


def grid_cells(marks: DataFrame, sheet: list[str], row: str, column: str, row_order: str, column_order: str) -> DataFrame:
    """A matrix in long form: r and c (from 1) of every mark, by the places of its row and column. No pivot, so any width."""

    def placed(name: str, order: str, out: str) -> DataFrame:
        once = marks.groupBy(*sheet, name).agg(F.min(order).alias("_o"))
        return once.withColumn(out, F.row_number().over(Window.partitionBy(*sheet).orderBy("_o", name))).drop("_o")

    both = marks.select(*sheet, row, column).distinct().join(placed(row, row_order, "r"), [*sheet, row]).join(placed(column, column_order, "c"), [*sheet, column])
    return both.withColumn("mark", F.lit("X"))


def records_of(cells: DataFrame, sheet: list[str], row: str, column: str, text: str) -> DataFrame:
    """Cells below a header row (the first) as header -> value, headers folded, up to the first blank row."""
    top = cells.groupBy(*sheet).agg(F.min(row).alias("_top"))
    all_ = cells.join(top, sheet).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    heads = all_.where(F.col(row) == F.col("_top")).select(*sheet, column, folded(F.col(text)).alias("header"))
    body = all_.where(F.col(row) > F.col("_top")).select(*sheet, row, column, F.col(text).alias("value"), "_top")
    rows = body.select(*sheet, row, "_top").distinct()
    nth = F.row_number().over(Window.partitionBy(*sheet).orderBy(row))
    before_gap = rows.withColumn("_n", nth).where(F.col(row) - F.col("_top") == F.col("_n")).select(*sheet, row)
    return body.join(before_gap, [*sheet, row]).join(heads, [*sheet, column]).select(*sheet, row, "header", "value")


def latest(log: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """The last entries of an append-only log, the newest first."""
    return log.orderBy(*(F.desc(c) for c in order)).limit(most)


def listing(studies: DataFrame, key: str, runs: DataFrame, run: str, started: str) -> DataFrame:
    """Each study with its runs nested, the newest first."""
    nested = F.sort_array(F.collect_list(F.struct(started, run)), asc=False)
    own = runs.groupBy(key).agg(nested.alias("runs"), F.max(started).alias("last_started"))
    return studies.join(own, key, "left")


def interrupted(runs: DataFrame, status: str, active: list[str], stages: str, reason: str = "interrupted") -> DataFrame:
    """Active runs become failed, and their running stages failed with the reason; stages maps names to (status, error)."""
    was = F.col(status).isin(active)
    failed = F.transform_values(
        stages, lambda _, s: F.when(s["status"] == "running", F.struct(F.lit("failed").alias("status"), F.lit(reason).alias("error"))).otherwise(F.struct(s["status"].alias("status"), s["error"].alias("error")))
    )
    return runs.withColumn(stages, F.when(was, failed).otherwise(F.col(stages))).withColumn(status, F.when(was, "failed").otherwise(F.col(status)))


def extraction_summary(calls: DataFrame, run: str, model: str, cost: str, fresh: Column, failed: Column, agent: str) -> DataFrame:
    """Per run: different models, calls made now, what they cost against all stored cost, and the failed agents (null if there are none)."""
    return calls.groupBy(run).agg(
        F.countDistinct(model).alias("models"), F.sum(F.when(fresh, 1).otherwise(0)).alias("calls"),
        F.round(F.sum(F.when(fresh, F.col(cost)).otherwise(0.0)), 6).alias("cost_now"), F.round(F.sum(cost), 6).alias("cost_stored"),
        F.when(F.max(F.when(failed, F.col(agent))).isNotNull(), F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col(agent)))), ",")).alias("failed"),
    )


def overall_items(items: DataFrame, by: list[str], pos: str, status: str, code: str, ranks: list[str]) -> DataFrame:
    """A cell of several resolved items: the worst status (ranks: the worst first), and the codes in order."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col(status))
    out = items.groupBy(*by).agg(F.min(rank).alias("_r"), F.array_sort(F.collect_list(F.struct(pos, code))).alias("_all"))
    return out.select(*by, F.element_at(F.array(*map(F.lit, ranks)), F.col("_r").cast("int")).alias(status), F.array_join(F.transform("_all", lambda x: x[code]), ", ").alias("codes"))


def allowed_choices(choices: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """choices with `allowed`: whether their code belongs to their codelist."""
    return choices.join(terms.select(*on).distinct().withColumn("allowed", F.lit(True)), on, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def unit_codes(phrases: DataFrame, phrase: str, units: DataFrame, code: str, names: list[str]) -> DataFrame:
    """Code of each distinct unit phrase by its names, then by the phrase without a trailing s; null for unknown units."""
    keys = units.select(code, F.explode(F.array(*(folded(F.col(n)) for n in names))).alias("_key")).groupBy("_key").agg(F.min(code).alias("_code"))
    own = phrases.select(phrase).distinct().withColumn("_key", folded(F.col(phrase)))
    found = own.join(keys, "_key", "left").withColumnRenamed("_code", "_whole").withColumn("_key", F.regexp_replace("_key", "s$", ""))
    return found.join(keys, "_key", "left").select(phrase, F.coalesce("_whole", "_code").alias(code))
