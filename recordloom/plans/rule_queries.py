"""Value rules, layout, matching and review operators bound to the given tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import layout, matching, review
from ..operators import records as r
from ..session import repeated
from ..sources.tables import lines, table
from ..streaming import review as revisions
from .queries import _LINES, QUERIES, query

_ENTITIES = "{}"
for _entity, _letter in v.ENTITIES.items():
    _ENTITIES = f"replace({_ENTITIES}, '{_entity}', '{_letter.replace(chr(39), chr(39) * 2)}')"
_SPACE = r"[\t\n\x0B\f\r \x{{85}}\p{{Z}}]+"
_NORMAL = "trim(regexp_replace(trim(lower(regexp_replace(" + _ENTITIES.format("regexp_replace({}, '<[^>]+>', ' ', 'g')") + f", '{_SPACE}', ' ', 'g'))), '^[.;:]+|[.;:]+$', '', 'g'))"


@query("SELECT page_id, md5(" + _NORMAL.format("html") + ") AS plain FROM pages")
def f3_normal_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(v.normal_text(F.col("html"))).alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'y' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ||
CASE l_partkey % 3 WHEN 1 THEN ' week' ELSE ' .. 7 day' END END AS value FROM lineitem""")
def f4_normal_value(spark, sf):
    text = F.when(F.col("l_partkey") % 3 == 0, "Yes.").when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("0"), "l_quantity", F.lit(" <b>Wks</b>"))).otherwise(F.concat("l_quantity", F.lit("..+7 Days;")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.normal_value(text).alias("value"))


_TITLE = r"regexp_replace(regexp_replace(replace(lower({}), '&', ' and '), '\(s\)|<#>|[{{}}]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
for _words, _one in v.SYNONYMS:
    _TITLE = rf"regexp_replace({_TITLE}, '\b(?:{_words.partition('(?!')[0].replace('{', '{{')})\b', '{_one}', 'g')"
_TITLE = (
    f"array_to_string(list_transform(list_filter(string_split({_TITLE}, ' '), lambda w: w <> '' AND NOT list_contains({v.STOPWORDS}, w) AND NOT regexp_matches(w, '^[0-9]+$')), "
    "lambda w: CASE WHEN length(w) > 4 AND regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|is|us)$') THEN w[:-2] ELSE w END), ' ')"
)


@query("SELECT doc_id, " + _TITLE.format("replace(substr(text, 1, 80), ' und ', ' Study of patients & ')") + " AS words FROM documents")
def f5_title_words(spark, sf):
    title = F.replace(F.substring("text", 1, 80), F.lit(" und "), F.lit(" Study of patients & "))
    return table(spark, sf, "documents").select("doc_id", v.title_words(title).alias("words"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Appendix ' || p_size END AS title FROM part""")
def f7_without_appendix(spark, sf):
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Annex "), "p_size", F.lit(". "), "p_name")).otherwise(F.concat(F.lit("Appendix "), "p_size"))
    return table(spark, sf, "part").select("p_partkey", v.without_appendix(title).alias("title"))


@query("SELECT conv_id, turn, md5(replace(replace(text, 'password', '***'), 'question', '***')) AS kept FROM conversations WHERE NOT regexp_matches(text, 'sk-|AKIA|gh[pousr]_')")
def f10_redacted(spark, sf):
    rows = table(spark, sf, "conversations").where(~F.col("text").rlike("sk-|AKIA|gh[pousr]_"))
    return rows.select("conv_id", "turn", F.md5(v.redacted(F.col("text"), ["password", "question", "the"])).alias("kept"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'must be a date as yyyy-mm-dd' END AS date_problem,
CASE WHEN o_orderkey % 3 = 1 THEN 'must be a whole number or a range such as 280..320' END AS count_problem, o_orderkey % 5 = 2 AS lacks FROM orders""")
def f13_format_problems(spark, sf):
    key = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    date = F.when(key % 4 == 0, F.replace(date, F.lit("-"), F.lit("/"))).otherwise(date)
    count = F.when(key % 3 == 1, F.concat(key, F.lit(" or so"))).otherwise(F.concat(key, F.lit(" .. "), key + 1))
    other = F.when(key % 5 == 2, "a, Other =").otherwise("Other=late")
    return table(spark, sf, "orders").select("o_orderkey", v.format_problem("date", date).alias("date_problem"), v.format_problem("count", count).alias("count_problem"), v.lacks_reason(other).alias("lacks"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), 'https://') THEN 'secure' WHEN regexp_matches(lower(url), 'http') THEN 'plain' END AS kind FROM pages""")
def f19_first_pattern(spark, sf):
    return table(spark, sf, "pages").select("page_id", v.first_pattern(F.col("url"), [("HTTPS://", "secure"), ("http", "plain")]).alias("kind"))


@query("""SELECT event_id, CAST(coalesce(round((user_id * 2.0 + event_id * 10.0) / 1e6, 6), 0) AS DOUBLE) AS cost FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, CAST(0 AS DOUBLE) FROM events WHERE event_type <> 'click' OR event_type IS NULL""")
def f21_call_cost(spark, sf):
    none = F.lit(0)
    usage = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), F.col("user_id").alias("input"), F.col("event_id").alias("output"), none.alias("cache_write"), none.alias("cache_read"))
    prices = spark.createDataFrame([("click", 2.0, 10.0)], "model string, price_in double, price_out double")
    return v.call_cost(usage, prices).select("event_id", "cost")


@query("""SELECT l_orderkey, '| line | part |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || '\\|' || l_suppkey || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS grid
FROM lineitem GROUP BY 1""")
def f22_markdown(spark, sf):
    row = F.array(F.col("l_linenumber").cast("string"), F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))).alias("all"))
    cells = F.concat(F.array(F.array(F.lit("line"), F.lit("part"))), F.transform("all", lambda x: x["row"]))
    return per.select("l_orderkey", v.markdown(cells).alias("grid"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, idx // 10 AS page, idx % 10 AS nth, text || CASE WHEN idx % 3 = 0 THEN ' ..... 12' ELSE '' END AS text FROM l)
SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) FILTER (nth % 1 = 0 AND regexp_matches(text, '(\\.{{4,}}|…{{2,}}|(\\. ){{4,}})\\s*[0-9]{{1,4}}\\s*$')) AS leaders, count(*) AS n FROM p GROUP BY 1, 2
HAVING leaders >= 5 OR leaders >= 0.4 * n""")
def d5_contents_pages(spark, sf):
    each = lines(table(spark, sf, "documents"))
    each = each.withColumn("text", F.concat("text", F.when(F.col("idx") % 3 == 0, " ..... 12").otherwise(""))).withColumn("nth", F.col("idx") % 10)
    return layout.contents_pages(each, ["doc_id", "page"], "text", "nth")


@query("""WITH e AS (SELECT conv_id, turn, turn // 3 AS page, coalesce(text, '') AS t, lag(turn // 3) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, min(page) AS page_start, max(page) AS page_end, md5(string_agg(CASE WHEN before IS DISTINCT FROM page THEN '[[PAGE ' || page || ']]' || chr(10) ELSE '' END || t, chr(10) ORDER BY turn)) AS text
FROM e GROUP BY 1""")
def d17_section_texts(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("page", F.floor(F.col("turn") / 3).cast("long"))
    out = layout.section_texts(rows, ["conv_id"], ["turn"], "page", "text")
    return out.withColumn("text", F.md5("text"))


@query("""WITH s AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 3 + 1 AS level, l_suppkey AS page_end FROM lineitem),
e AS (SELECT a.*, (SELECT min(b.pos) FROM s b WHERE b.doc = a.doc AND b.pos > a.pos AND b.level <= a.level) AS stop FROM s a)
SELECT e.doc, e.pos, e.level, max(b.page_end) AS page_end FROM e JOIN s b ON b.doc = e.doc AND b.pos >= e.pos AND b.pos < coalesce(e.stop, 1000000) GROUP BY 1, 2, 3""")
def d18_page_ends(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.expr("row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)").alias("pos"), (F.col("l_partkey") % 3 + 1).alias("level"), F.col("l_suppkey").alias("page_end"))
    return layout.page_ends(rows, ["doc"], "pos", "level", "page_end")


@query("""SELECT l_orderkey, count(*) AS n_rows, 3 AS n_cols, count(*) FILTER (l_partkey % 5 = 0) AS merged, round(count(*) FILTER (l_partkey % 5 = 0) / (3.0 * count(*)), 3) AS empty_ratio FROM lineitem GROUP BY 1""")
def b1_grid_shape(spark, sf):
    row = F.array(F.col("l_linenumber").cast("string"), F.when(F.col("l_partkey") % 5 != 0, F.lit("X")), F.lit("Day 1"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("cells"))
    shape = layout.grid_shape(F.col("cells"))
    return per.select("l_orderkey", *(shape[c].cast("double" if c == "empty_ratio" else "long").alias(c) for c in ("n_rows", "n_cols", "merged", "empty_ratio")))


@query("""SELECT l_orderkey, CASE WHEN count(*) < 3 THEN 0 ELSE round(0.4 * least(least(count(*), 3) / 4.0, 1) + 0.4 * least(((count(*) FILTER (l_linenumber <> 1 AND l_partkey % 2 = 0)) / ((count(*) - 1) + count(*) FILTER (l_linenumber <> 1 AND l_partkey % 2 = 0))) / 0.25, 1), 3) END AS score
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1""")
def b3_schedule_score(spark, sf):
    row = F.array(F.lit("Procedure"), F.when(F.col("l_partkey") % 2 == 0, "X").otherwise(""), F.lit("Day 1"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("all"), F.countDistinct("l_linenumber").alias("n"), F.min("l_linenumber").alias("first"))
    per = per.where("n = size(all) and first = 1")
    return per.select("l_orderkey", layout.schedule_score(F.transform("all", lambda x: x["row"]), F.lit(False)).alias("score"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'Arm' ELSE 'Visit' END || CASE WHEN n > 1 THEN ' ' || n ELSE '' END AS "unique" FROM o""")
def r2_unique_names(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, "Arm").otherwise("Visit").alias("name"))
    return review.unique_names(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "name").drop("name")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS parent FROM conversations""")
def r4_filled_down(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat("role", "turn")).otherwise("").alias("parent"))
    return review.filled_down(rows, ["conv_id"], ["turn"], ["parent"])


@query("""SELECT o_custkey, trim(lower(o_orderpriority)) AS o_orderpriority, count(*) AS n, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS "values" FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def r5_listed_twice(spark, sf):
    out = review.listed_twice(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus")
    return out.withColumn("values", F.array_join("values", ","))


@query("""SELECT o_orderkey, c.c_name AS name, c.c_name IS NULL AND o_custkey IS NOT NULL AS unknown FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON c_custkey = o_custkey""")
def r6_looked_up(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 3 > 0")
    return review.looked_up(table(spark, sf, "orders"), "o_custkey", known, "c_custkey", "c_name").select("o_orderkey", F.col("c_name").alias("name"), "unknown")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey % 3 AS r, l_linenumber AS key FROM lineitem)
SELECT l_orderkey, r, coalesce(string_agg('v' || key, ', ' ORDER BY key) FILTER (key < 5), '') AS names, coalesce(string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) FILTER (key >= 5), '') AS unknown FROM m GROUP BY 1, 2""")
def r9_marks_joined(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("r"), F.col("l_linenumber").alias("key"))
    visits = items.where("key < 5").select("l_orderkey", "key").distinct().withColumns({"pos": F.col("key"), "visit": F.concat(F.lit("v"), "key")})
    return review.marks_joined(items, visits, ["l_orderkey"], "r", "key", "pos", "visit").withColumn("unknown", F.array_join("unknown", ","))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 10 = 0")
def v2_missing_names(spark, sf):
    rows = table(spark, sf, "orders").withColumn("name", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority")).otherwise(" "))
    return review.missing_names(rows, "name", F.col("o_orderstatus") != "P").select("o_orderkey")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber = 1 AS required, l_linenumber = 2 AS coded, l_suppkey % 4 = 0 AS empty, l_partkey % 2 = 0 AS exact, l_discount * 10 AS confidence, l_suppkey % 3 = 0 AS verified FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'unknown' AS issue, true AS blocking FROM f WHERE l_linenumber > 3 UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'required' AS issue, true AS blocking FROM f WHERE required AND empty UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'terminology', true FROM f WHERE coded AND NOT empty AND NOT exact UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'low confidence', false FROM f WHERE NOT empty AND confidence < 0.7 UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'unverified', false FROM f WHERE NOT empty AND NOT verified""")
def v4_field_issues(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 4 != 0, "x").alias("value"), F.when(F.col("l_partkey") % 2 == 0, "exact").otherwise("fuzzy").alias("status"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_suppkey") % 3 == 0).alias("verified"),
    )
    shape = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, False)], "l_linenumber int, required boolean, coded boolean")
    out = review.field_issues(rows, shape, ["l_linenumber"], "value", "status", "confidence", "verified", F.lit(False))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "issue", "blocking")


@query("""SELECT event_type AS rule, user_id % 5 AS run, count(*) AS n, CASE event_type WHEN 'click' THEN 'expected' WHEN 'view' THEN 'review' ELSE 'other' END AS kind, least(count(*), 20) AS listed FROM events GROUP BY 1, 2""")
def v7_noted_findings(spark, sf):
    found = table(spark, sf, "events").select(F.col("event_type").alias("rule"), (F.col("user_id") % 5).alias("run"))
    notes = spark.createDataFrame([("click", "expected"), ("view", "review")], "rule string, kind string")
    return review.noted_findings(found, notes, "rule", "kind", ["run"], 20)


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'error' ELSE 'warning' END AS kind, 'at ' || event_type AS message, CASE WHEN event_id % 3 = 0 THEN event_type || '.' || user_id ELSE 'sheet ' || event_type || ', row ' || user_id END AS location FROM events""")
def v11_import_issues(spark, sf):
    some = F.col("event_id") % 3 != 0
    user = F.col("user_id").cast("string")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "Error").otherwise("Warning").alias("level"), F.concat(F.lit("at "), "event_type", F.lit("\n\nDetails: none")).alias("message"),
        F.when(some, F.col("event_type")).alias("sheet"), F.when(some, user).alias("row"), F.concat(F.lit("a.b."), "event_type").alias("class_name"), F.concat(F.lit("m."), user).alias("method"),
    )
    out = review.import_issues(rows.withColumn("message", F.concat("message", F.lit("|"), "event_id")).withColumn("message", F.concat("event_id", F.lit("|"), "message")), "level", "message", ["sheet", "row"], ["class_name", "method"])
    return out.select(F.split_part("message", F.lit("|"), F.lit(1)).cast("long").alias("event_id"), "kind", F.split_part("message", F.lit("|"), F.lit(2)).alias("message"), "location")


@query("""SELECT l_orderkey % 50 AS sheet, CASE WHEN l_linenumber = 1 AND l_suppkey % 4 = 0 THEN 'required' WHEN l_suppkey % 4 > 0 AND l_partkey % 5 = 0 THEN 'terminology' WHEN l_partkey % 5 = 1 THEN 'edited'
WHEN l_suppkey % 4 > 0 AND l_discount < 0.03 THEN 'low' WHEN l_suppkey % 4 = 0 THEN 'empty' WHEN l_partkey % 5 = 2 THEN 'generated' ELSE 'ok' END AS state, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def v12_cell_states(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("value", F.when(F.col("l_suppkey") % 4 != 0, "x"))
    part = F.col("l_partkey") % 5
    out = review.cell_states(rows, "value", F.col("l_linenumber") == 1, part == 0, part == 1, F.col("l_discount") < 0.03, part == 2)
    return out.groupBy((F.col("l_orderkey") % 50).alias("sheet"), "state").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey AS s, l_linenumber AS c, l_suppkey FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3)
SELECT s, 1 AS row, 'label' AS label, coalesce((SELECT string_agg('head' || c, ', ' ORDER BY c) FROM (SELECT DISTINCT c FROM c x WHERE x.s = o.s AND l_suppkey % 2 = 0 AND (SELECT count(*) FROM c y WHERE y.s = x.s AND y.c = x.c) = 1)), '') AS marks
FROM (SELECT DISTINCT s FROM c) o WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.s = o.s GROUP BY z.c HAVING count(*) > 1)""")
def w3_marks_of(spark, sf):
    items = table(spark, sf, "lineitem").where("l_linenumber between 1 and 3")
    twice = items.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select("l_orderkey").distinct()
    items = items.join(twice, "l_orderkey", "left_anti").select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("c"), "l_suppkey")
    heads = items.select("s", F.lit(0).alias("row"), "c", F.concat(F.lit("head"), "c").alias("text"))
    labels = items.select("s", F.lit(1).alias("row"), F.lit(0).alias("c"), F.lit("label").alias("text")).distinct()
    marks = items.select("s", F.lit(1).alias("row"), "c", F.when(F.col("l_suppkey") % 2 == 0, "x").otherwise("-").alias("text"))
    out = review.marks_of(heads.union(labels).union(marks), ["s"], "row", "c", "text")
    return out.withColumn("marks", F.coalesce("marks", F.lit("")))


@query("""WITH m AS (SELECT l_orderkey % 20 AS s, l_suppkey AS a, l_linenumber AS t FROM lineitem)
SELECT DISTINCT s, a, t, dense_rank() OVER (PARTITION BY s ORDER BY a) AS r, dense_rank() OVER (PARTITION BY s ORDER BY t) AS c, 'X' AS mark FROM m""")
def w2_grid_cells(spark, sf):
    marks = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).alias("s"), F.col("l_suppkey").alias("a"), F.col("l_linenumber").alias("t"))
    return review.grid_cells(marks, ["s"], "a", "t", "a", "t")


@query("""WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, turn - min(turn) OVER (PARTITION BY conv_id) AS off FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id, turn, 'text' AS header, md5(text) AS value FROM k WHERE n > 0 AND n = off""")
def w5_records_of(spark, sf):
    rows = table(spark, sf, "conversations").where("trim(coalesce(text, '')) <> ''")
    top = rows.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    cells = rows.join(top.withColumn("head", F.lit(True)), ["conv_id", "turn"], "left").select("conv_id", "turn", F.lit(0).alias("c"), F.when(F.col("head"), " Text").otherwise(F.col("text")).alias("text"))
    return review.records_of(cells, ["conv_id"], "turn", "c", "text").withColumn("value", F.md5("value"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def s2_latest(spark, sf):
    return review.latest(table(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""SELECT c_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC) FILTER (o_orderkey IS NOT NULL), ',') AS runs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def s5_listing(spark, sf):
    runs = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = review.listing(table(spark, sf, "customer").select("c_custkey"), "c_custkey", runs, "o_orderkey", "o_orderdate")
    return out.select("c_custkey", F.array_join(F.transform("runs", lambda x: x["o_orderkey"].cast("string")), ",").alias("runs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 'failed' WHEN o_custkey % 2 = 0 THEN 'running' ELSE 'done' END AS stage FROM orders""")
def l7_interrupted(spark, sf):
    stage = F.struct(F.when(F.col("o_custkey") % 2 == 0, "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"))
    runs = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.create_map(F.lit("parse"), stage).alias("stages"))
    return review.interrupted(runs, "status", ["O"], "stages").select("o_orderkey", "status", F.col("stages")["parse"]["status"].alias("stage"))


@query("""SELECT user_id, count(DISTINCT event_type) AS models, CAST(count(*) FILTER (event_id % 2 = 0) AS BIGINT) AS calls, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_id % 7 = 0)), ',') AS failed FROM events GROUP BY 1""")
def o2_extraction_summary(spark, sf):
    calls = table(spark, sf, "events").withColumn("cost", F.lit(0.0))
    out = review.extraction_summary(calls, "user_id", "event_type", "cost", F.col("event_id") % 2 == 0, F.col("event_id") % 7 == 0, "event_type")
    return out.select("user_id", "models", "calls", "failed")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_suppkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'unresolved' END AS status FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(status = 'unresolved') THEN 'unresolved' WHEN bool_or(status = 'fuzzy') THEN 'fuzzy' ELSE 'exact' END AS status, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey) AS codes FROM i GROUP BY 1""")
def c3_overall_items(spark, sf):
    kind = F.element_at(F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("unresolved")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"), kind.alias("status"))
    items = items.withColumns({"pos": F.struct("l_linenumber", "l_partkey"), "code": F.col("l_partkey").cast("string")})
    return review.overall_items(items, ["l_orderkey"], "pos", "status", "code", ["unresolved", "fuzzy", "exact"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 2 = 0) AS allowed FROM lineitem""")
def c4_allowed_choices(spark, sf):
    terms = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return review.allowed_choices(table(spark, sf, "lineitem"), terms, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "allowed")


@query("""WITH p AS (SELECT DISTINCT lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN 's' ELSE '' END AS phrase, n_name FROM nation, region WHERE n_regionkey = r_regionkey)
SELECT p.phrase, min(n.n_nationkey) AS code FROM p LEFT JOIN nation n ON lower(n.n_name) = p.phrase OR (NOT EXISTS (SELECT 1 FROM nation k WHERE lower(k.n_name) = p.phrase) AND lower(n.n_name) = regexp_replace(p.phrase, 's$', '')) GROUP BY 1""")
def c5_unit_codes(spark, sf):
    units = table(spark, sf, "nation")
    phrases = units.select(F.concat(F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "s").otherwise("")).alias("phrase"))
    return review.unit_codes(phrases, "phrase", units, "n_nationkey", ["n_name"]).withColumnRenamed("n_nationkey", "code")


@query("""WITH s AS (SELECT l_orderkey AS u, l_linenumber AS p, l_partkey % 4 AS a, l_suppkey % 3 AS b, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem),
g AS (SELECT * FROM s WHERE k = 1), m AS (SELECT u, p, CASE WHEN u % 5 = 0 THEN (a + 1) % 4 ELSE a END AS a, b FROM g WHERE p % 4 > 0),
x AS (SELECT u, greatest(max(p), 1) AS z FROM g GROUP BY 1), y AS (SELECT u, greatest(max(p), 1) AS z FROM m GROUP BY 1)
SELECT g.u, g.p AS i, m.p AS j, round(0.85 * ((CASE WHEN g.a = m.a THEN 1 ELSE 0 END) + (CASE WHEN g.b = m.b THEN 1 ELSE 0 END)) / 2 + 0.15 * (1 - abs(g.p / x.z - m.p / y.z)), 6) AS score
FROM g JOIN m USING (u) JOIN x USING (u) JOIN y USING (u)
WHERE round(0.85 * ((CASE WHEN g.a = m.a THEN 1 ELSE 0 END) + (CASE WHEN g.b = m.b THEN 1 ELSE 0 END)) / 2 + 0.15 * (1 - abs(g.p / x.z - m.p / y.z)), 6) >= 0.45""")
def e5_row_pairs(spark, sf):
    return _pairs(spark, sf)[2]


def _pairs(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("u"), F.col("l_linenumber").alias("p")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    gold = rows.select("u", "p", (F.col("x.l_partkey") % 4).alias("a"), (F.col("x.l_suppkey") % 3).alias("b"))
    made = gold.where("p % 4 > 0").withColumn("a", F.when(F.col("u") % 5 == 0, (F.col("a") + 1) % 4).otherwise(F.col("a")))
    return gold, made, matching.row_pairs(gold, made, ["u"], "p", ["a", "b"])


@query("""SELECT l_orderkey, sum(g) AS gold, sum(m) AS generated, sum(CASE WHEN g = 1 AND m = 1 AND l_suppkey % 4 > 0 THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN g = 1 AND m = 1 AND l_suppkey % 4 = 0 THEN 2 ELSE 1 END) AS slots FROM
(SELECT l_orderkey, l_linenumber, l_suppkey, 1 AS g, CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END AS m, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1 GROUP BY 1""")
def e9_cell_tally(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("p")).agg(F.min_by("l_suppkey", F.struct("l_partkey", "l_suppkey")).alias("s"))
    gold = rows.withColumn("code", F.col("s").cast("string"))
    made = rows.where("p % 3 > 0").withColumn("code", F.when(F.col("s") % 4 > 0, F.col("s").cast("string")).otherwise("wrong"))
    pairs = made.select("l_orderkey", F.col("p").alias("i"), F.col("p").alias("j"))
    return matching.cell_tally(gold, made, pairs, ["l_orderkey"], "p", "code")


@query("""WITH t AS (SELECT DISTINCT lower(p_name) AS title FROM part WHERE p_partkey % 2 = 0), n AS (SELECT DISTINCT p_brand AS node, lower(p_name) AS variant FROM part WHERE p_partkey % 2 = 1),
a AS (SELECT DISTINCT title, unnest(string_split(title, ' ')) AS w FROM t), b AS (SELECT DISTINCT node, variant, unnest(string_split(variant, ' ')) AS w FROM n),
c AS (SELECT title, count(*) AS k FROM a GROUP BY 1), d AS (SELECT node, variant, count(*) AS k FROM b GROUP BY 1, 2),
s AS (SELECT title, node, variant, count(*) AS k FROM a JOIN b USING (w) GROUP BY 1, 2, 3)
SELECT title, node, max(round(2.0 * s.k / (c.k + d.k), 3)) AS score FROM s JOIN c USING (title) JOIN d USING (node, variant) GROUP BY 1, 2""")
def m3_title_scores(spark, sf):
    part = table(spark, sf, "part")
    titles = part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("title"))
    template = part.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("node"), F.lower("p_name").alias("variant"))
    weights = part.select(F.lit("no such word").alias("word"), F.lit(1.0).alias("weight")).distinct()
    return matching.title_scores(titles, "title", template, "node", "variant", weights, 1.0)


@query("""WITH d AS (SELECT DISTINCT o_custkey AS doc FROM orders), t AS (SELECT DISTINCT l_linenumber AS node FROM lineitem),
a AS (SELECT o_custkey AS doc, l_linenumber AS node, max(l_discount * 10) AS best FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT doc, node, CASE WHEN best IS NULL THEN 'missing' WHEN best >= 0.7 THEN 'found' ELSE 'low_confidence' END AS state FROM d CROSS JOIN t LEFT JOIN a USING (doc, node)""")
def m7_coverage(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("node"), (F.col("l_discount") * 10).alias("confidence"))
    assigned = items.join(docs, "l_orderkey")
    return matching.coverage(docs, "doc", items, "node", assigned, "confidence", "l_orderkey").select("doc", "node", "state")




@query("""SELECT l_orderkey, CASE WHEN bool_or(l_partkey % 9 = 0) THEN least(min(l_discount * 10), 0.8) ELSE least(min(l_discount * 10), 1.0) END AS confidence, bool_and(l_suppkey % 5 > 0) AS verified FROM lineitem GROUP BY 1""")
def q7_joined_confidence(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"confidence": F.col("l_discount") * 10, "verified": F.col("l_suppkey") % 5 > 0})
    return matching.joined_confidence(rows, ["l_orderkey"], "confidence", "verified", F.col("l_partkey") % 9 == 0)


def l2_revisions(spark, sf):
    """Batches of a user's events, each made against the number of batches that it saw; some are invalid or change nothing."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("batch_id"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("base_revision"),
        (F.col("event_id") % 11 > 0).alias("valid"), (F.col("event_id") % 3 > 0).alias("changed"),
    )
    return revisions.revisions(revisions.of_operations(rows))


def e6_best_pairs(spark, sf):
    return matching.best_pairs(_pairs(spark, sf)[2], ["u"])


def c2_candidates(spark, sf):
    """Names of a tenth of the parts, against names and types of another tenth, of the same brand."""
    part = table(spark, sf, "part").select("p_brand", "p_name", "p_type", "p_partkey")
    phrases = part.where("p_partkey % 10 = 0").select("p_brand", F.col("p_name").alias("phrase"))
    return matching.candidates(phrases, "p_brand", "phrase", part.where("p_partkey % 10 = 1"), "p_partkey", ["p_name", "p_type"])


def e2_text_scores(spark, sf):
    """Names of parts of one brand and size, paired with their neighbour's; different pairs are scored once, then repeated as often as they occur."""
    names = table(spark, sf, "part").groupBy("p_brand", "p_size", "p_name").agg(F.count("*").alias("n"))
    side = lambda c: names.select("p_brand", "p_size", F.col("p_name").alias(c), F.col("n").alias(f"n_{c}"))
    both = side("a").join(side("b"), ["p_brand", "p_size"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n"))
    return repeated(matching.text_scores(both, "a", "b"), "n")


def f1_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(v.clean_text(F.col("text"))).alias("clean"))


QUERIES |= {f.__name__: f for f in (l2_revisions, e6_best_pairs, c2_candidates, e2_text_scores, f1_clean_text)}
