"""Cell formats and texts bound to the given tables, with the DuckDB SQL of the same rows."""

from pyspark.sql import functions as F

from ..functions import cells
from ..sources.tables import table
from .queries import query


def _with_units(rows, spark, sf):
    """Nations as units: their key as code, their name as preferred and submission value."""
    nation = table(spark, sf, "nation")
    return cells.with_units(rows, nation.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.lower("n_name").alias("preferred"), F.col("n_name").alias("submission")))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, chr(233) || chr(32) || chr(128578) || l_linestatus || chr(8805) AS text FROM lineitem""")
def f9_decoded(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("\\u00E9 \\ud83d\\ude42"), "l_linestatus", F.lit("\\u2265")).alias("text"))
    return cells.decoded_leaves(rows)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 27 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat_ws(' ', q || '.5', CASE WHEN n < 25 THEN coalesce(n_name, 'N' || n) WHEN n = 25 THEN 'pints' END) END AS amount,
CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat_ws(' ', q || '..' || (q + 10), CASE WHEN n < 25 THEN coalesce(n_name, 'N' || n) WHEN n = 25 THEN 'pints' END) END AS span
FROM l LEFT JOIN nation ON n_nationkey = n""")
def f12_formatted(spark, sf):
    n = F.col("l_suppkey") % 27
    rows = table(spark, sf, "lineitem").join(F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name")), F.col("n") == n, "left")  # 25 nations
    unit = F.when(n < 25, F.when(n % 2 == 0, F.concat(F.lower("n_name"), F.lit("s"))).otherwise(F.concat(F.lit("n"), n.cast("string")))).when(n == 25, " pints ")
    q = F.col("l_quantity").cast("long")
    number = F.when(F.col("l_partkey") % 5 == 0, "some").otherwise(F.concat(q.cast("string"), F.lit(".50")))
    low = F.when(F.col("l_partkey") % 5 == 0, "some").otherwise(F.concat(q.cast("string"), F.lit(".0")))
    rows = _with_units(rows.withColumns({"unit": unit, "number": number, "low": low, "high": (q + 10).cast("string")}), spark, sf)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cells.format_quantity(F.col("number"), F.col("unit")).alias("amount"), cells.format_range(F.col("low"), F.col("high"), F.col("unit")).alias("span"))


@query(r"""WITH o AS (SELECT o_orderkey, o_custkey % 6 AS k, o_orderkey % 7 AS n, o_custkey % 30 AS u FROM orders),
v AS (SELECT o_orderkey, ['boolean', 'date', 'quantity', 'count', 'duration', 'geographic_scope'][k + 1] AS kind, CASE k WHEN 0 THEN ['Y', 'no', '1', 'maybe', 'true', ' ', 'N.'][n + 1] WHEN 1 THEN ['2020-01-0' || n, '1.2.2020'][n % 2 + 1]
WHEN 2 THEN n || ['', '.5', '.00'][n % 3 + 1] || ' N' || u WHEN 3 THEN [n || '..9', n || '..9 N1', n || '', n || '.5'][n % 4 + 1] WHEN 4 THEN n || [' weeks', 'd', ' pints'][n % 3 + 1] ELSE ['Global', 'Region: x', 'Europe', 'Global: 3', 'Country: ', 'Global, Country: a', 'x'][n + 1] END AS value FROM o)
SELECT o_orderkey, kind, value, CASE WHEN trim(value) = '' THEN NULL WHEN kind = 'boolean' AND lower(value) NOT IN ('y', 'no', '1', 'true') THEN true WHEN kind = 'date' AND NOT regexp_matches(value, '^\d{4}-\d\d-\d\d$') THEN true
WHEN kind = 'quantity' AND CAST(regexp_extract(value, 'N(\d+)$', 1) AS INTEGER) > 24 THEN true WHEN kind = 'quantity' AND contains(value, '.5') THEN false
WHEN kind = 'count' AND (contains(value, 'N1') OR contains(value, '.5')) THEN true WHEN kind = 'duration' AND contains(value, 'pints') THEN true
WHEN kind = 'geographic_scope' AND value IN ('Europe', 'Global: 3', 'Country: ', 'x') THEN true END AS blocking FROM v""")
def f13_formats(spark, sf):
    k, n, u = F.col("o_custkey") % 6, F.col("o_orderkey") % 7, F.col("o_custkey") % 30
    pick = lambda of, at: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in of)), (at + 1).cast("int"))
    t = n.cast("string")
    value = (
        F.when(k == 0, pick(["Y", "no", "1", "maybe", "true", " ", "N."], n)).when(k == 1, pick([F.concat(F.lit("2020-01-0"), t), "1.2.2020"], n % 2)).when(k == 2, F.concat(t, pick(["", ".5", ".00"], n % 3), F.lit(" N"), u.cast("string")))
        .when(k == 3, pick([F.concat(t, F.lit("..9")), F.concat(t, F.lit("..9 N1")), t, F.concat(t, F.lit(".5"))], n % 4)).when(k == 4, F.concat(t, pick([" weeks", "d", " pints"], n % 3))).otherwise(pick(["Global", "Region: x", "Europe", "Global: 3", "Country: ", "Global, Country: a", "x"], n))
    )
    kind = pick(["boolean", "date", "quantity", "count", "duration", "geographic_scope"], k)
    rows = _with_units(table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), value.alias("value")), spark, sf)
    return rows.select("o_orderkey", "kind", "value", cells.format_problem(F.col("kind"), F.col("value"))["blocking"].alias("blocking"))


@query("""SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN o_orderstatus || ', ' || lower(o_orderpriority) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN '<p>&lt;' || o_orderpriority || '&gt;</p>' ELSE trim(o_orderpriority) END AS written FROM orders""")
def f17_cell_text(spark, sf):
    k = F.col("o_custkey") % 4
    value = F.when(k == 0, F.concat(F.lit(" a ,"), "o_orderpriority")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.concat(F.lit("<"), "o_orderpriority", F.lit(">"))).otherwise(F.col("o_orderpriority"))
    preferred = F.when(k == 0, F.concat_ws(", ", "o_orderstatus", F.lower("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", cells.cell_text(value, preferred, k == 0, k == 0, F.lit(False), F.when(k == 1, "date"), k == 2).alias("written"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE replace(c_name, '#', ' ') || '||' || n_name || '|' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END || '||' || n_nationkey END AS address FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def f18_address(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = F.array(F.replace("c_name", F.lit("#"), F.lit("|")), F.lit(" "))
    country = F.when(F.col("c_custkey") % 5 > 0, F.col("n_nationkey").cast("string"))
    return rows.select("c_custkey", cells.address(lines, F.lit(None), F.col("n_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit(""), country).alias("address"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'about ' || l_partkey WHEN l_suppkey % 4 = 1 THEN l_partkey || '' ELSE l_partkey || '..' || (l_partkey + 1) END AS planned,
CASE l_linenumber % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS healthy, CASE WHEN l_linenumber % 2 = 0 THEN 'Female, Male' ELSE l_linestatus END AS sex FROM lineitem""")
def f20_population(spark, sf):
    key, k = F.col("l_partkey").cast("string"), F.col("l_suppkey") % 4
    low, high = F.when(k == 0, F.concat(F.lit("about "), key)).otherwise(key), F.when(k > 1, (F.col("l_partkey") + 1).cast("string"))
    answer = F.element_at(F.array(F.lit(" YES "), F.lit("false"), F.lit("perhaps")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    sex = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_linestatus", F.lit(", Both"))).otherwise(F.col("l_linestatus"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cells.format_count(low, high).alias("planned"), cells.flag(answer).alias("healthy"), cells.planned_sex(sex).alias("sex"))
