"""Each operator bound to the given tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import documents as d
from ..operators import layout
from ..operators import records as r
from ..sources.tables import lines, table, unique_uploads

QUERIES, SQL = {}, {}
_LINES = "l AS (SELECT doc_id, text AS t, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"
_FOLD = "trim(lower(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_KEY = "CASE WHEN regexp_matches(lower({0}), '(^|[^\\p{{L}}\\p{{N}}_])page([^\\p{{L}}\\p{{N}}_]|$)') OR length(lower({0})) <= 12 THEN regexp_replace(lower({0}), '[0-9]+', '#', 'g') ELSE lower({0}) END"


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, idx, idx // 10 AS page, {_KEY.format('text')} AS key FROM l),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1), b AS (SELECT * FROM p WHERE idx % 10 IN (0, 1, 8, 9)),
o AS (SELECT doc_id, key FROM b JOIN n USING (doc_id) GROUP BY 1, 2 HAVING count(DISTINCT page) >= greatest(3, floor(any_value(pages) * 0.25)))
SELECT doc_id, CAST(page AS BIGINT) AS page, CAST(idx AS INTEGER) AS idx FROM b LEFT JOIN (SELECT *, 1 AS f FROM o) USING (doc_id, key)
WHERE f IS NOT NULL OR regexp_matches(key, '^((document\\s+)?page\\s*)?#{{1,4}}(\\s*(of|/)\\s*#{{1,4}})?$|^-\\s*#{{1,4}}\\s*-$')""")
def d3_running_lines(spark, sf):
    """Running lines of each document: pages of ten lines, whose first and last two are the bands."""
    each = lines(table(spark, sf, "documents"))
    return layout.running_lines(each, ["doc_id"], "page", "text", (F.col("idx") % 10).isin(0, 1, 8, 9)).select("doc_id", "page", "idx")


@query("""SELECT l_suppkey, arg_max(l_linenumber, (w, -l_linenumber)) AS body_size FROM
(SELECT l_suppkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def d2_body_size(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("w0", F.col("l_quantity").cast("long"))
    return d.body_size(rows, ["l_suppkey"], "l_linenumber", "w0")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def d16_as_of_section(spark, sf):
    rows = table(spark, sf, "events").withColumn("section", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return d.as_of(rows, ["user_id"], ["ts", "event_id"], "section").select("user_id", "event_id", "section")


@query("""WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM b GROUP BY 1, 2""")
def b4_chained_runs(spark, sf):
    rows = table(spark, sf, "events")
    runs = d.islands(rows, ["user_id"], ["ts", "event_id"], lambda w: ~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)))
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '(Exit)') AS next_name FROM conversations")
def r7_next_or_exit(spark, sf):
    return d.next_or_exit(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "role", "next_name")


@query("""WITH h AS (SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS sha FROM documents),
f AS (SELECT source, sha, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM h GROUP BY 1, 2)
SELECT source, sha, lang, doc_id, copies, CASE WHEN n > 1 THEN lang || ' (' || n || ')' ELSE lang END AS stored FROM
(SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM f)""")
def s3_unique_uploads(spark, sf):
    return unique_uploads(table(spark, sf, "documents"), "source", "lang", "text", "doc_id")


@query(f"""SELECT doc_id, md5({_FOLD.format('text')}) AS folded, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS title_key FROM documents""")
def f2_folded_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(fx.folded(F.col("text"))).alias("folded"), F.md5(fx.title_key(F.col("text"))).alias("title_key"))


@query("""SELECT event_id, CAST(len(x) AS INTEGER) AS n_items, array_to_string(x, '|') AS item_list FROM (SELECT event_id,
list_distinct_ordered AS x FROM (SELECT event_id, list_filter(list_transform(string_split(props, ','), lambda y: trim(y)), lambda y, i: y <> '' AND
list_position(list_transform(string_split(props, ','), lambda z: trim(z)), y) = i) AS list_distinct_ordered FROM events))""")
def f15_items(spark, sf):
    x = fx.items(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.size(x).alias("n_items"), F.array_join(x, "|").alias("item_list"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) ELSE chr(CAST(64 + i // 26 AS INTEGER)) || chr(CAST(65 + i % 26 AS INTEGER)) END AS cell
FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 702 AS i FROM lineitem)""")
def f14_column_letter(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fx.column_letter(F.col("l_suppkey") % 702).alias("cell"))


@query("""WITH k AS (SELECT lower(p_brand) AS key, 0 AS priority, p_partkey AS code, 'p_brand' AS m FROM part UNION ALL
SELECT lower(p_type), 1, p_partkey, 'p_type' FROM part), b AS (SELECT key, min((priority, code, m)) AS b FROM k GROUP BY 1),
q AS (SELECT DISTINCT p_type AS phrase FROM part UNION SELECT DISTINCT event_type FROM events)
SELECT phrase, b[2] AS code, b[3] AS matched_on FROM q LEFT JOIN b ON lower(phrase) = key""")
def c1_exact_terms(spark, sf):
    part, events = table(spark, sf, "part"), table(spark, sf, "events")
    phrases = part.select(F.col("p_type").alias("phrase")).union(events.select("event_type"))
    return r.exact_terms(phrases, "phrase", part, ["p_brand", "p_type"], "p_partkey")


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def c7_unique_keys(spark, sf):
    return r.unique_keys(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("""SELECT p_brand, p_name, count(*) AS n, array_to_string(list_sort(list(CAST(p_partkey AS VARCHAR))), ',') AS locations
FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def v1_duplicate_names(spark, sf):
    return r.duplicates(table(spark, sf, "part"), ["p_brand", "p_name"], "p_partkey")


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'SEGMENT-' || o_custkey % 5 ELSE 'segment-' || o_custkey % 5 END AS target FROM orders),
e AS (SELECT DISTINCT 'segment-' || c_custkey % 4 AS name FROM customer)
SELECT o_orderkey, target, h.hint FROM f ANTI JOIN e ON target = e.name LEFT JOIN (SELECT lower(name) AS low, min(name) AS hint FROM e GROUP BY 1) h ON lower(target) = low""")
def v3_dangling_references(spark, sf):
    name = F.concat(F.lit("segment-"), F.col("o_custkey") % 5)
    refs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 == 0, F.upper(name)).otherwise(name).alias("target"))
    ents = table(spark, sf, "customer").select(F.concat(F.lit("segment-"), F.col("c_custkey") % 4).alias("name")).distinct()
    return r.dangling(refs, "target", ents, "name").select("o_orderkey", "target", "hint")


@query("""SELECT o_orderkey, o_orderstatus || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS name FROM
(SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)""")
def r1_sequence_names(spark, sf):
    return r.sequence_names(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"], F.col("o_orderstatus")).select("o_orderkey", "name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1
THEN l_orderkey END AS shown_l_orderkey FROM lineitem""")
def r3_two_level(spark, sf):
    rows = r.two_level(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "shown_l_orderkey")


@query("""WITH a AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events)
SELECT user_id, arg_max(event_type, event_id) AS current, CAST(sum(CASE WHEN event_type IS DISTINCT FROM o THEN 1 ELSE 0 END) AS BIGINT) AS revisions FROM a GROUP BY 1""")
def l1_current_values(spark, sf):
    return r.current_values(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type")


@query("""SELECT user_id, event_id, event_type, o AS old_value FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events)
WHERE event_type IS DISTINCT FROM o""")
def l5_audit(spark, sf):
    return r.audit(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", "event_type", "old_value")


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_orderkey % 11 <> 0 THEN 1 ELSE 0 END AS gold, CASE WHEN l_partkey % 7 <> 0 THEN 1 ELSE 0 END AS generated FROM lineitem),
m AS (SELECT *, gold * generated AS matched FROM p),
g AS (SELECT l_returnflag, l_linestatus, sum(gold) AS gold, sum(generated) AS generated, sum(matched) AS matched FROM m GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()))
SELECT l_returnflag, l_linestatus, CAST(gold AS BIGINT) AS gold, CAST(generated AS BIGINT) AS generated, CAST(matched AS BIGINT) AS matched,
round(matched / nullif(generated, 0), 4) AS precision, round(matched / nullif(gold, 0), 4) AS recall FROM g""")
def e10_roll_up(spark, sf):
    flag = lambda c, n: F.when(F.col(c) % n != 0, 1).otherwise(0)
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", flag("l_orderkey", 11).alias("gold"), flag("l_partkey", 7).alias("generated"))
    pairs = rows.withColumn("matched", F.col("gold") * F.col("generated"))
    return r.tallied(pairs, [["l_returnflag", "l_linestatus"], ["l_returnflag"], []])


@query("""SELECT o_orderstatus AS status, count(*) AS runs, count(DISTINCT o_custkey) AS models, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent FROM orders GROUP BY 1""")
def o1_runs_summary(spark, sf):
    urgent = F.sum(F.when(F.col("o_orderpriority").like("1%"), 1).otherwise(0))
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("runs"), F.countDistinct("o_custkey").alias("models"), urgent.alias("urgent"))
