"""Rules on single values, by hand-made cases."""

import itertools

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import fuzzy
from recordloom.functions import text as fx
from recordloom.functions import values as v


def each(spark, rule, values):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names_numbers_and_titles(spark):
    assert each(spark, fx.safe_name, ["a;b\tc", 'x, "y"', "", None, "w" * 70]) == ["a b c", "x y", "item", "item", "w" * 60]
    assert each(spark, fx.number_text, ["1,200", "2.50", "007", "+5", "1.123456", "3.0", "100", "x", None]) == ["1200", "2.5", "007", "+5", None, "3", "100", None, None]
    titles = ["(Section A) overview", "Überblick über alles", "lower case title", "Ends here.", "5 Study", "A", "One, two;"]
    assert each(spark, fx.plausible_title, titles) == [True, True, False, False, True, False, False]
    assert each(spark, fx.repeat_key, ["Page 5 of 97", "12", "homepage has 12 items", "Appendix 1 of the protocol"]) == ["page # of #", "#", "homepage has 12 items", "appendix 1 of the protocol"]
    assert each(spark, fx.is_page_label, ["page # of #", "- # -", "#", "page one"]) == [True, True, True, False]
    assert each(spark, lambda x: fx.cell_reference(F.length(x) - 1, F.lit(2)), ["a", "a" * 27]) == ["A2", "AA2"]


def test_values_fold_to_one_form(spark):
    same = [("2 Weeks", "2 week"), ("50..100 YEARS", "50 .. 100 years"), ("TRUE", "Y"), ("yes", "t"), ("01", "1"), ("2.50 mg", "2.5 mg")]
    for a, b in same:
        assert len(set(each(spark, v.normal_value, [a, b]))) == 1, (a, b)
    assert each(spark, v.normal_text, ["<p>ANC &lt; 1.5</p>", "ANC < 1.5.", None]) == ["anc < 1.5", "anc < 1.5", None]
    assert each(spark, v.clean_text, ["Table 1.  Dose� Le­vels", "ﬁne", None]) == ["Table 1. Dose Levels", "fine", None]
    assert each(spark, v.title_words, ["Patient Selection", "Schedule of Events"]) == ["participant selection", "schedule activitie"]
    assert each(spark, v.without_appendix, ["Appendix 2. Hachinski Ischemic Scale", "Appendix A", "Plain"]) == ["Hachinski Ischemic Scale", "Appendix A", "Plain"]
    assert each(spark, lambda x: v.redacted(x, ["short", "longsecret", "longsecret99"]), ["a longsecret99 b short", "key sk-abcdefgh12 end"]) == ["a *** b short", "key *** end"]
    assert each(spark, v.lacks_reason, ["Other", "a, other = ", "Other=because", "Otherwise", None]) == [True, True, False, False, None]
    dates = each(spark, lambda x: v.format_problem("date", x), ["2024-01-02", "2.1.2024", " ", None])
    assert dates[0] is None and "yyyy" in dates[1] and dates[2:] == [None, None]
    pick = lambda x: v.first_pattern(x, [(r"\bNCT[0-9]{8}\b", "one"), ("isrctn", "two")])
    assert each(spark, pick, ["see NCT12345678", "ISRCTN1", "none"]) == ["one", "two", None]


def test_grids_as_markdown_and_costs(spark):
    df = spark.createDataFrame([([["a|b", "c"], ["d"], [None, "e"]],)], "g array<array<string>>")
    assert df.select(v.markdown(F.col("g"))).first()[0] == "| a\\|b | c |\n|---|---|\n| d |  |\n|  | e |"
    usage = spark.createDataFrame([("m", 1000, 10, 100, 1000), ("x", 5, 5, 5, 5)], "model string, input long, output long, cache_write long, cache_read long")
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, price_in double, price_out double")
    assert {r.model: r.cost for r in v.call_cost(usage, prices).collect()} == {"m": 0.00255, "x": 0.0}


@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_common_subsequence_equals_the_table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert fuzzy.common(a, b) == best[-1][-1]


def test_ratios(spark):
    assert fuzzy.plain_ratio("this is a test", "this is a test!") == 200 * 14 / 29
    assert fuzzy.plain_token_sort("new york mets", "mets york new") == 100 and fuzzy.plain_token_set("placebo", "placebo control arm") == 100
    df = spark.createDataFrame([("ab", "abc"), (None, "a")], "x string, y string")
    assert [r[0] for r in df.select(fuzzy.ratio("x", "y")).collect()] == [80.0, None]
