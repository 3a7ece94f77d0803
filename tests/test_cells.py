"""Formats, cell texts and escapes by known cases."""

import pytest
from pyspark.sql import functions as F

from recordloom.functions import cells as c

UNITS = [("C1", "Milligram", "mg"), ("C2", "Year", "YEARS"), ("C3", "Week", "WEEKS"), ("C4", "Day", "DAYS"), ("C5", "Percent", "%")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "code string, preferred string, submission string")


def each(spark, units, schema, rows, rule):
    df = c.with_units(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}"), units)
    return [r.y for r in df.select("i", rule.alias("y")).orderBy("i").collect()]


def test_formats(spark, units):
    cases = [
        ("boolean", "Y", None), ("boolean", "maybe", True), ("boolean", "0", None), ("date", "2015-10-20", None), ("date", "20 October 2015", True), ("quantity", "125 mg", None), ("quantity", "24 WEEKS", None), ("quantity", "300", None),
        ("quantity", "125 mg once daily", True), ("quantity", "2.5 mg", False), ("quantity", "2.50 mgs", True), ("quantity", "2.0 c1", None), ("quantity", "mg", True), ("range", "18..75 YEARS", None), ("range", "18..75 years", None), ("range", "18..75 weekss", None), ("range", "18..75 pints", True),
        ("range", "18 .. 75 days", None), ("range", "18..75", True), ("range", "18 YEARS", True), ("count", "300", None), ("count", "280..320", None), ("count", "280..320 mg", True), ("count", "about 300", True), ("count", "1.5", True),
        ("geographic_scope", "Global", None), ("geographic_scope", "Region: Europe, Country: GBR", None), ("geographic_scope", "Europe", True), ("geographic_scope", "Global: x", True), ("geographic_scope", "Region:", True),
        ("enrollment", "Global: 300", None), ("enrollment", "Country: GBR=40, Site: 1=2", None), ("enrollment", "300", True), ("enrollment", "Global: many", True), ("enrollment", "Planet: 3=4", True), ("enrollment", "Region: =4", True), ("enrollment", "Cohort: a=b", True),
        ("duration", "2 weeks", None), ("duration", "2.5 weeks", True), ("duration", "2 mg", True), ("window", "-3..3 days", None), ("window", "-3..3", True), ("window", "-3..3 mg", True), ("window", "-3..3 hours", True), ("amendment_reason", "anything", None), ("date", "  ", None), ("date", None, None), (None, "x", None),
    ]
    got = each(spark, units, "k string, v string", [x[:2] for x in cases], c.format_problem(F.col("k"), F.col("v")))
    assert [(k, v, p and p.blocking) for (k, v, _), p in zip(cases, got, strict=True)] == cases
    assert got[cases.index(("count", "1.5", True))].message == "must be a whole number"


def test_formatted_values(spark, units):
    assert each(spark, units, "v string, u string", [("1,200.50", "mg"), ("3", "weeks"), ("3", "week"), ("3", "pints"), ("3", " "), ("3", None), ("x", "mg"), (None, "mg")], c.format_quantity(F.col("v"), F.col("u"))) == ["1200.5 mg", "3 WEEKS", "3 WEEKS", "3 pints", "3", "3", None, None]
    assert each(spark, units, "a string, b string, u string", [("18", "75.0", "year"), ("18", None, "year"), ("1", "2", "")], c.format_range(F.col("a"), F.col("b"), F.col("u"))) == ["18..75 YEARS", None, "1..2"]
    assert each(spark, units, "a string, b string", [("240", None), ("1,000", "2000"), ("about 5", "6"), (None, "6"), ("5", "x")], c.format_count(F.col("a"), F.col("b"))) == ["240", "1000..2000", "about 5", None, "5"]
    assert each(spark, units, "a string", [(" Yes",), ("n",), ("maybe",), (None,)], c.flag(F.col("a"))) == ["Y", "N", None, None]
    assert each(spark, units, "a string", [("Male, Both",), ("Male",), (None,)], c.planned_sex(F.col("a"))) == ["Female, Male", "Male", None]
    assert each(spark, units, "a boolean", [(True,), (False,), (None,)], c.format_boolean(F.col("a"))) == ["Y", "N", None]


def test_cell_texts(spark, units):
    rows = [
        (" x ", None, False, False, False, None, False, "x"), ("a, b", "Alpha, Beta", True, True, False, None, False, "Alpha, Beta"), ("a, b", "Alpha", True, True, False, None, False, "a, b"), ("a", "Alpha", False, False, False, None, True, "<p>a</p>"),
        ("Other = why, b", "Other, Beta", True, True, True, None, False, "Other=why,Beta"), ("2020-01-02", None, None, False, False, "date", False, "2020-01-02 00:00:00"), ("a < b & \"c\"", None, False, False, False, None, True, "<p>a &lt; b &amp; \"c\"</p>"),
        (None, "Alpha", True, True, True, "date", True, ""), ("  ", None, False, False, False, "date", False, ""),
    ]
    names = "v p e m o k x".split()
    kinds = "string string boolean boolean boolean string boolean".split()
    got = each(spark, units, ", ".join(map(" ".join, zip(names, kinds, strict=True))), [r[:7] for r in rows], c.cell_text(*map(F.col, names)))
    assert got == [r[7] for r in rows]
    assert each(spark, units, "a string", [("Other= x =y",), ("other=",), ("Others",), (None,)], c.other_reason(F.col("a"))) == ["x =y", None, None, None]


def test_addresses(spark, units):
    rows = [(["1 High|Street ", " "], None, "London", None, "W1", "GBR"), ([], "d", "Rome", "s", None, "ITA"), (None, None, "Rome", None, None, "ITA"), (["x"], None, None, None, None, "ITA"), (["x"], None, "Rome", None, None, None)]
    got = each(spark, units, "l array<string>, d string, c string, s string, p string, k string", rows, c.address(*map(F.col, "ldcspk")))
    assert got == ["1 High Street||London||W1|GBR", "|d|Rome|s||ITA", "||Rome|||ITA", None, None]


def test_escapes_of_nested_values(spark):
    row = ("a \\u2265 5", ["\\u00e9\\u00E9", None, "\\u12"], {"k\\u0041": "\\ud83d\\ude42 x"}, ("\\u0041", 3))
    df = spark.createDataFrame([row, (None, None, None, None)], "t string, a array<string>, m map<string,string>, s struct<x: string, n: int>")
    first, second = c.decoded_leaves(df).collect()
    assert (first.t, first.a, first.m, tuple(first.s)) == ("a ≥ 5", ["éé", None, "\\u12"], {"k\\u0041": "🙂 x"}, ("A", 3)) and tuple(second) == (None,) * 4
