"""Artefacts, timings and roll-ups bound to the given tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import functions as F

from ..operators import reports, review, schedule
from ..session import shared_folder
from ..sources import artefacts
from ..sources.tables import table
from .queries import QUERIES, query

_CHAT = "conv_id long, turns array<struct<turn: long, role: string, text: string>>"


@query("""SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || text, '' ORDER BY turn)) AS texts, false AS bad FROM conversations WHERE conv_id % 7 > 0 GROUP BY 1
UNION ALL SELECT NULL, CAST(count(DISTINCT conv_id) AS BIGINT), NULL, true FROM conversations WHERE conv_id % 7 = 0""")
def s1_artefacts(spark, sf):
    """Conversations written as nested JSON, every seventh broken off in the middle, and read back."""
    path = shared_folder(spark)
    chats = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.lit("unknown").alias("extra"))
    whole = F.to_json(F.struct("conv_id", "turns", "extra"))
    chats.select(F.when(F.col("conv_id") % 7 == 0, F.expr("substring(to_json(struct(conv_id, turns)), 1, 40)")).otherwise(whole).alias("value")).write.text(path)
    good, bad = artefacts.read_artefacts(spark, path, _CHAT, whole_files=False)
    texts = F.md5(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], t["text"])), ""))
    read = good.select("conv_id", F.size("turns").cast("long").alias("n_turns"), texts.alias("texts"), F.lit(False).alias("bad"))
    return read.unionByName(bad.agg(F.count("*").alias("n_turns")).select(F.lit(None).cast("long").alias("conv_id"), "n_turns", F.lit(None).cast("string").alias("texts"), F.lit(True).alias("bad")))


@query("""SELECT l_orderkey % 20 AS study_id, l_linenumber AS run_id, count(*) AS n, sum(CASE WHEN l_linenumber = 2 THEN l_partkey + 1 ELSE l_partkey END) AS parts FROM lineitem GROUP BY 1, 2""")
def s6_results(spark, sf):
    """Lines written by study and run, one run of all studies written again, and read back."""
    path = shared_folder(spark)
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).alias("study_id"), F.col("l_linenumber").alias("run_id"), "l_partkey")
    artefacts.write_results(rows, path)
    artefacts.write_results(rows.where("run_id = 2").withColumn("l_partkey", F.col("l_partkey") + 1), path)
    return artefacts.read_results(spark, path, rows.schema).groupBy("study_id", "run_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber AS pos, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, p % 4 = 0 AS anchor, count(*) FILTER (p % 4 = 0) OVER (PARTITION BY l_orderkey) AS n, first_value(pos) OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN p % 4 = 0 THEN 0 ELSE 1 END, pos) AS a FROM v),
t AS (SELECT *, pos <> a AND n = 1 AND s % 6 > 1 AND s % 5 < 4 AS timed FROM m)
SELECT l_orderkey, pos, CASE WHEN pos = a THEN 'Fixed Reference' WHEN timed AND p % 2 = 0 THEN 'After' WHEN timed THEN 'Before' END AS type, CASE WHEN pos = a THEN '0 days' WHEN timed THEN s || CASE WHEN s % 5 < 2 THEN ' days' ELSE ' weeks' END END AS value,
CASE WHEN pos = a OR timed THEN 'T' || a END AS relative_to, CASE WHEN timed AND p % 3 = 0 THEN '-2..0 days' END AS win FROM t""")
def r8_timings(spark, sf):
    pick = [F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")]
    v = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pos")).agg(*pick)
    offset = F.when(F.col("s") % 6 == 0, None).when(F.col("s") % 6 == 1, F.concat(F.col("s").cast("string"), F.lit(".5"))).otherwise(F.concat(F.col("s").cast("string"), F.lit(".0")))
    unit = F.when(F.col("s") % 5 < 2, " Days").when(F.col("s") % 5 < 4, "weeks").otherwise("mg")
    visits = v.select("l_orderkey", "pos", F.col("pos").alias("key"), F.concat(F.lit("T"), "pos").alias("timepoint"), (F.col("p") % 4 == 0).alias("anchor"), offset.alias("offset_value"), unit.alias("unit"), F.when(F.col("p") % 2 == 0, "after").otherwise("before").alias("direction"), F.lit("2").alias("win_before"), F.lit(None).cast("string").alias("win_after"), F.when(F.col("p") % 3 == 0, "days").alias("win_unit"))
    return schedule.timings(visits, ["l_orderkey"], "pos").select("l_orderkey", "pos", "type", "value", "relative_to", F.col("window").alias("win"))


@query("""SELECT l_suppkey, max(CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 10 / 10.0 ELSE 0.0 END) AS best, count(*) FILTER (l_linenumber % 2 = 0) AS wide FROM lineitem GROUP BY 1""")
def b5_group_scores(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", F.lit(1).alias("group_id"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 10 / 10).otherwise(0.0).alias("score"), F.lit(2).alias("n_rows"), F.lit(5).alias("n_cols"), F.lit(0).alias("merged"), F.lit(0.0).alias("empty_ratio"), (F.col("l_linenumber") % 2 == 0).alias("landscape"), F.lit(False).alias("under_schedule"))
    done = reports.finished_tables(rows, "l_suppkey")
    return done.groupBy("l_suppkey").agg(F.max("group_score").alias("best"), F.sum(F.array_contains("reasons", "landscape_wide_table").cast("long")).alias("wide"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, count(DISTINCT i // 10) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars, count(*) AS lines, count(*) FILTER (i % 10 = 0) AS removed, count(DISTINCT CASE WHEN i // 10 % 3 = 1 THEN i // 10 END) AS landscape FROM l GROUP BY 1""")
def d19_document_totals(spark, sf):
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("page", F.floor(F.col("i") / 10)).withColumn("running", F.col("i") % 10 == 0)
    pages = each.select("doc_id", "page").distinct().withColumns({"landscape": F.col("page") % 3 == 1, "contents": F.col("page") == 2})
    return reports.page_totals(each, pages, "doc_id", "page")[1].drop("contents")


@query("""WITH c AS (SELECT topic, conv_id, turn, '<section id="' || turn || '" number="" title="' || role || '" pages="' || turn || '-' || (turn + 1) || '">' || chr(10) || CASE WHEN turn % 2 = 0 THEN '[[TABLE ' || conv_id || ']]' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN '| x |' ELSE '(table not available)' END || chr(10) || '[[/TABLE]]' ELSE '' END || text || chr(10) || '</section>' AS s
FROM conversations, (SELECT 'a' AS topic UNION ALL SELECT 'b') WHERE topic = 'a' OR turn > 1)
SELECT conv_id, topic, md5(string_agg(s, chr(10) || chr(10) ORDER BY turn)) AS text FROM c GROUP BY 1, 2""")
def m9_contexts(spark, sf):
    rows = table(spark, sf, "conversations")
    text = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[[TABLE "), "conv_id", F.lit("]]"))).otherwise(""), "text")
    sections = rows.select("conv_id", F.col("turn").alias("section_id"), F.col("turn").alias("pos"), F.lit(None).cast("string").alias("number"), F.col("role").alias("title"), F.col("turn").alias("page_start"), (F.col("turn") + 1).alias("page_end"), text.alias("text"))
    chosen = rows.select(F.lit("a").alias("topic"), "conv_id", F.col("turn").alias("section_id")).unionByName(rows.where("turn > 1").select(F.lit("b").alias("topic"), "conv_id", F.col("turn").alias("section_id")))
    tables = rows.where("conv_id % 2 = 0").select("conv_id", F.col("conv_id").cast("string").alias("table_id"), F.lit("| x |").alias("markdown")).distinct()
    return reports.rendered_contexts(chosen, sections, "conv_id", "pos", tables).withColumn("text", F.md5("text"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c FROM orders), g AS (SELECT *, c - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY c) AS r FROM l)
SELECT o_custkey, o_orderstatus, min(c) AS first, max(c) AS last FROM g GROUP BY o_custkey, o_orderstatus, r""")
def w7_header_spans(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_custkey", "o_orderstatus", "cast(row_number() over (partition by o_custkey order by o_orderkey) as long) as c")
    return reports.header_spans(rows, ["o_custkey"], "c", "o_orderstatus")


@query("""WITH t AS (SELECT l_suppkey, count(*) AS g, count(*) FILTER (l_partkey % 3 > 0) AS m FROM lineitem WHERE l_linenumber < 4 GROUP BY 1), o AS (SELECT l_suppkey, count(*) AS x FROM lineitem WHERE l_linenumber >= 4 GROUP BY 1)
SELECT l_suppkey, coalesce(g, 0) AS gold, coalesce(m, 0) AS matched, coalesce(x, 0) AS outside, round(coalesce(m, 0) / (coalesce(g, 0) + coalesce(x, 0)), 4) AS recall FROM t FULL JOIN o USING (l_suppkey)""")
def e12_recall_with_outside(spark, sf):
    rows = table(spark, sf, "lineitem")
    inside = rows.where("l_linenumber < 4").select("l_suppkey", F.lit(1).alias("gold"), (F.col("l_partkey") % 3 > 0).cast("long").alias("matched"))
    return reports.recall_with_outside(inside, rows.where("l_linenumber >= 4").select("l_suppkey", F.lit(1).alias("n")), ["l_suppkey"])


@query("""SELECT o_orderkey, l_linenumber FROM orders, (SELECT DISTINCT l_linenumber FROM lineitem) s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_linenumber = s.l_linenumber)""")
def e14_not_scored(spark, sf):
    lines = table(spark, sf, "lineitem")
    gold = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return reports.not_scored(lines.select("l_linenumber"), table(spark, sf, "orders"), gold, "o_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'")
def c9_other_releases(spark, sf):
    return reports.other_releases(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT").select("o_orderkey", "o_orderpriority")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) AS lead, max(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) AS below, max(CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END) AS more, max(CASE WHEN l_partkey % 21 = 0 THEN 1 ELSE 0 END) AS unit FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS f FROM c)
SELECT l_orderkey, l_linenumber, 'label' AS field, 'empty row' AS issue FROM s WHERE lead + below + more = 0 UNION ALL SELECT l_orderkey, l_linenumber, 'name', 'first row starts no entry' FROM s WHERE lead + below + more > 0 AND f AND lead = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'unit', 'required' FROM s WHERE lead + below + more > 0 AND below = 1 AND unit = 0""")
def v5_structure_issues(spark, sf):
    """Orders as sheets of two levels: a name of the upper one, a label and a unit of the lower one, each in some of the lines."""
    rows = table(spark, sf, "lineitem").withColumn("sheet", F.lit("lines"))
    cell = lambda n, field: rows.where(F.col("l_partkey") % n == 0).select("l_orderkey", "sheet", "l_linenumber", F.lit(field).alias("field"), F.lit("x").alias("value")).distinct()
    layout = spark.createDataFrame([("lines", "name", True, 1, "lead"), ("lines", "label", True, 2, "below"), ("lines", "unit", True, 3, "below"), ("lines", "note", False, 4, None)], "sheet string, field string, required boolean, nth int, grp string")
    cells = cell(5, "name").unionByName(cell(3, "label")).unionByName(cell(7, "note"))
    lacks = review.structure_issues(rows.select("l_orderkey", "sheet", "l_linenumber").distinct(), cells.unionByName(cell(21, "unit")), layout, ["l_orderkey", "sheet"], "l_linenumber")
    return lacks.select("l_orderkey", "l_linenumber", "field", "issue")


def c6_ranked_terms(spark, sf):
    """Types of parts, in part blank, asked of the names of each brand; tests hold ranks against plain Python."""
    part = table(spark, sf, "part")
    asked = part.where("p_partkey % 25 = 0").select("p_brand", F.when(F.col("p_size") % 4 > 0, F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("asked"))
    return review.ranked_terms(asked, "p_brand", "asked", part.select("p_brand", "p_partkey", "p_name", "p_type"), "p_partkey", "p_name", ["p_name", "p_type"])


QUERIES["c6_ranked_terms"] = c6_ranked_terms
