"""Run bookkeeping, reshaping and text rules bound to the given tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import runs
from ..sources.tables import lines, table
from .queries import query


@query("SELECT o_orderkey, sha256(concat(o_orderstatus, chr(0), o_orderpriority, chr(0))) AS input_hash FROM orders")
def s8_input_hash(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", runs.input_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("input_hash"))


@query("""WITH n AS (SELECT c_custkey AS key, c_custkey % 2 AS inputs, c_nationkey % 2 AS post FROM customer),
s AS (SELECT o_custkey AS key, min(o_orderkey % 2) AS inputs, max(o_orderkey % 2) AS post, max(o_orderstatus) AS status FROM orders GROUP BY 1)
SELECT n.key, CASE WHEN s.key IS NULL OR n.inputs <> s.inputs THEN 'run' WHEN n.post <> s.post THEN 'reprocess' ELSE 'skip' END AS action
FROM n LEFT JOIN s ON n.key = s.key AND s.status IN ('F', 'O')""")
def s7_reuse_plan(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 2).alias("inputs"), (F.col("c_nationkey") % 2).alias("post"))
    odd = F.col("o_orderkey") % 2
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min(odd).alias("inputs"), F.max(odd).alias("post"), F.max("o_orderstatus").alias("status"))
    return runs.reuse_plan(new, stored, "key", "inputs", "post", "status", ["F", "O"])


@query("""WITH c AS (SELECT o_custkey AS key, max(o_orderkey) AS value, max(o_orderkey) % 5 = 0 AS failed FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS key, -c_custkey AS value FROM customer)
SELECT coalesce(c.key, s.key) AS key, CASE WHEN c.key IS NULL THEN s.value ELSE c.value END AS value FROM c FULL JOIN s ON c.key = s.key WHERE c.key IS NULL OR NOT failed""")
def s9_precedence(spark, sf):
    now = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value")).withColumn("failed", F.col("value") % 5 == 0)
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (-F.col("c_custkey")).alias("value"))
    return runs.precedence(now, stored, ["key"], "value", "failed")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 3 + 1 AS level FROM events)
SELECT user_id, event_id, CASE level WHEN 2 THEN last_value(CASE WHEN level < 2 THEN event_id END IGNORE NULLS) OVER w
WHEN 3 THEN last_value(CASE WHEN level < 3 THEN event_id END IGNORE NULLS) OVER w END AS parent FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def d14_parents(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("level"))
    return runs.parents(rows, ["user_id"], ["event_id"], "level", "event_id", 3).select("user_id", "event_id", "parent")


@query("""SELECT l_suppkey, x[CAST(floor(0.9 * (len(x) - 1)) AS BIGINT) + 1] AS l_extendedprice FROM
(SELECT l_suppkey, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1)""")
def d7_right_edge(spark, sf):
    return runs.order_statistic(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9)


@query("""WITH a AS (SELECT DISTINCT p_brand, p_type FROM part), e AS (SELECT DISTINCT p_brand, p_size FROM part)
SELECT p_brand, p_type, p_size, CASE WHEN p_size % 2 = 0 THEN p_type || '-' || p_size ELSE CAST(p_size AS VARCHAR) END AS element FROM a JOIN e USING (p_brand)""")
def r10_design(spark, sf):
    part = table(spark, sf, "part")
    return runs.design(part, part.withColumn("treated", F.col("p_size") % 2 == 0), "p_brand", "p_type", "p_size", "treated")


@query("""WITH g AS (SELECT o_custkey, o_orderkey, o_orderstatus AS gold FROM orders WHERE o_orderkey % 11 <> 0),
m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS made FROM orders WHERE o_orderkey % 7 <> 0),
d AS (SELECT *, CASE WHEN made IS NULL THEN 'missing' WHEN gold IS NULL THEN 'extra' ELSE 'mismatch' END AS kind FROM g FULL JOIN m USING (o_custkey, o_orderkey) WHERE gold IS DISTINCT FROM made)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM d) WHERE n <= 25""")
def e11_differences(spark, sf):
    orders = table(spark, sf, "orders")
    made = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).where("o_orderkey % 7 <> 0")
    return runs.differences(orders.where("o_orderkey % 11 <> 0"), made, ["o_custkey", "o_orderkey"], "o_orderstatus", "o_custkey")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS blocking,
CAST(sum(CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS warnings, sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) = 0 AS confirmable FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def v6_issue_totals(spark, sf):
    return runs.totals(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.08, F.col("l_tax") > 0.05)


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS choices FROM part GROUP BY 1")
def v10_choices(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("choices"))


@query("""SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(props, '"([A-Za-z]+)"[ ]*:', 1)) AS name FROM events) GROUP BY 1""")
def v8_key_counts(spark, sf):
    names = F.regexp_extract_all("props", F.lit('"([A-Za-z]+)"[ ]*:'), F.lit(1))
    return table(spark, sf, "events").select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT p_name FROM part), w AS (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS word FROM t)
SELECT word, round(ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)) + 1, 9) AS weight FROM w WHERE word <> '' GROUP BY 1""")
def m1_word_weights(spark, sf):
    return runs.inverse_frequency(table(spark, sf, "part"), "p_name").select("word", F.round("weight", 9).alias("weight"))


@query("""SELECT p_partkey, 'p_name' AS header, p_name AS cell FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
UNION ALL SELECT p_partkey, 'p_type', p_type FROM part""")
def w1_key_values(spark, sf):
    return table(spark, sf, "part").unpivot("p_partkey", ["p_name", "p_brand", "p_type"], "header", "cell")


@query("""SELECT o_custkey, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS F, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS O,
min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS P FROM orders GROUP BY 1""")
def w4_grid(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.min("o_orderkey"))


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders""")
def e13_change(spark, sf):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - before, 2).alias("change"))


@query("""SELECT source, lang, count(*) AS sections, CAST(sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM documents
GROUP BY GROUPING SETS ((source, lang), (source), ())""")
def o4_flagged(spark, sf):
    flagged = F.sum(F.when(F.col("n_chars") < 200, 1).otherwise(0)).alias("flagged")
    return table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("sections"), flagged)


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[,;''"\\r\\n\\t]', ' ', 'g'), '[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]+', ' ', 'g')) AS p, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, coalesce(nullif(rtrim(substring(p, 1, 60)), ''), 'item') AS safe, CASE WHEN length(f) > 80 THEN substring(f, 1, 79) || '…' ELSE f END AS shown FROM t""")
def f8_f23_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.safe_name(F.col("text")).alias("safe"), fx.display_cell(F.col("text")).alias("shown"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, count(*) AS titles FROM l WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 2 AND length(text) <= 160
AND len(string_split(trim(lower(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), ' ')) <= 22 AND regexp_matches(text, '^([0-9]|\\P{L}*\\p{Lu})') AND NOT regexp_matches(text, '[,;]$|\\.\\s*$') GROUP BY 1""")
def f24_titles(spark, sf):
    each = lines(table(spark, sf, "documents")).where(fx.plausible_title(F.col("text")))
    return each.groupBy("doc_id").agg(F.count("*").alias("titles"))


@query("""WITH c AS (SELECT o_custkey AS key, min(o_orderkey) % 3 AS print, max(o_orderkey) % 2 AS revision FROM orders GROUP BY 1)
SELECT key, array_to_string(list_filter([CASE WHEN key % 3 <> print THEN 'input changed' END, CASE WHEN c_nationkey % 2 <> revision THEN 'revision changed' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM c JOIN customer ON key = c_custkey WHERE key % 3 <> print OR c_nationkey % 2 <> revision""")
def v9_stale(spark, sf):
    key = F.col("o_custkey").alias("key")
    made = table(spark, sf, "orders").groupBy(key).agg((F.min("o_orderkey") % 3).alias("print"), (F.max("o_orderkey") % 2).alias("revision"))
    now = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 3).alias("print"), (F.col("c_nationkey") % 2).alias("revision"))
    found = runs.stale(made, now, ["key"], {"print": "input changed", "revision": "revision changed"})
    return found.select("key", F.array_join("reasons", "|").alias("reasons"))


@query("""SELECT l_shipdate, count(*) AS n FROM lineitem l ANTI JOIN (SELECT DISTINCT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') o
ON l.l_orderkey = o.l_orderkey GROUP BY 1""")
def w6_unmapped(spark, sf):
    layout = table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return runs.unmapped(table(spark, sf, "lineitem"), layout, ["l_orderkey"], ["l_shipdate"])


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS produced,
CASE WHEN sum(CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) > 0 THEN 'awaiting_review' ELSE 'failed' END AS status FROM lineitem GROUP BY 1""")
def o3_run_status(spark, sf):
    return runs.run_status(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") >= 40)
