"""Quote verification against plain Python."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.functions import fuzzy
from recordloom.operators import quotes
from recordloom.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
HAY = "female aged 18 years or older. histologically confirmed hr-positive, her2-negative breast cancer. received 20 october2015"


def plain_place(needle, hay):
    """Position by the three ways, each by trying every place."""
    if not needle:
        return -1
    found = re.search((r"(?<!\w)" if needle[0].isalnum() else "") + re.escape(needle) + (r"(?!\w)" if needle[-1].isalnum() else ""), hay)
    if found:
        return found.start()
    if any(c.isdigit() for c in needle) or len(needle.split()) >= 3:
        for at in range(len(hay)):
            if hay[at] == " ":
                continue
            k, i = 0, at
            dense = needle.replace(" ", "")
            while i < len(hay) and k < len(dense) and (hay[i] == " " or hay[i] == dense[k]):
                k += hay[i] != " "
                i += 1
            if k == len(dense) and not (at and hay[at - 1].isalnum() and needle[0].isalnum()) and not (i < len(hay) and hay[i].isalnum() and needle[-1].isalnum()):
                return at
    if len(needle) >= 20:
        best = plain_window(needle, hay, 90)
        if best and not (best[0] and hay[best[0] - 1].isalnum()):
            part = hay[best[0] : best[1]]
            if all(re.findall(p, needle) == re.findall(p, part) for p in (r"\d+(?:[.,]\d+)?", r"\b(?:no|not|non|without|never|except|excluding)\b")):
                return best[0]
    return -1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_window(needle, hay, least):
    if len(hay) < len(needle):
        turned = plain_window(hay, needle, least) if hay else None
        return turned and (0, len(hay), turned[2])
    m, n = len(needle), len(hay)
    spans = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
    best = None
    for b, e in spans:
        score = 200 * lcs(needle, hay[b:e]) / (m + e - b)
        if score >= least and (best is None or score > best[2]):
            best = (b, e, score)
    return best


@pytest.mark.parametrize(
    ("quote", "found"),
    [("female aged 18 years or older.", True), ("histologically confirmed hr positive, her2-negative breast cancer", True), ("male aged 18 years", False),
     ("female aged 65 years or older.", False), ("confirmed hr-positive, her2-negative breast cancer not", False), ("20 october 2015", True), ("", False), ("male", False), ("aged 1", False), ("cancer", True)],
)
def test_known_quotes(quote, found):
    assert (quotes.place(quote, HAY) >= 0) == found and quotes.place(quote, HAY) == plain_place(quote, HAY)


@given(st.text(st.sampled_from("ab 1é-"), max_size=12).map(lambda s: " ".join(s.split())), st.text(st.sampled_from("ab 1é-"), max_size=60).map(lambda s: " ".join(s.split())))
@settings(max_examples=500, deadline=None)
def test_places_equal_plain_search(needle, hay):
    assert quotes.place(needle, hay) == plain_place(needle, hay)


@given(st.text(st.sampled_from("abcd "), min_size=1, max_size=24), st.text(st.sampled_from("abcd "), max_size=70), st.sampled_from([60.0, 80.0, 90.0]))
@settings(max_examples=200, deadline=None)
def test_best_windows_equal_trying_all(needle, hay, least):
    assert fuzzy.best_window(needle, hay, least) == plain_window(needle, hay, least)


@given(st.integers(0, 60), st.integers(0, 60), st.sampled_from(["x", "", "no "]))
@settings(max_examples=60, deadline=None)
def test_long_quotes_with_slips(start, slip, put):
    needle = HAY[start : start + 40].strip()
    needle = needle[: slip % 40] + put + needle[slip % 40 + 1 :]
    assert quotes.place(needle, HAY) == plain_place(needle, HAY)


SECTIONS = [
    ("d", "sec-4.1", 1, 10, "Female aged 18 years or older.\n[[PAGE 11]]\nHistologically confirmed HR-positive,\nHER2-negative breast cancer [[TABLE t1]] tail"),
    ("d", "sec-4.2", 2, 12, "Known hypersensitivity to study drug. [[TABLE nowhere]]"), ("d", "sec-4.3", 3, 13, None), ("e", "sec-4.1", 1, 1, "other document"),
]
TABLES = [("d", "t1", 14, "sec-4.1", [["Dose", None, "10 mg"], ["", "Arm", "A"]])]


def searched(spark):
    rows = spark.createDataFrame(SECTIONS, "doc string, section string, pos int, page int, text string")
    tables = spark.createDataFrame(TABLES, "doc string, table_id string, table_page int, owner string, cells array<array<string>>")
    hay = quotes.searchable(rows, "doc", "section", "page", rows.text, tables)
    return hay.join(rows.select("doc", "section", "pos"), ["doc", "section"]), tables


def test_searchable_text_and_pages(spark):
    got = {(r.doc, r.section): r for r in searched(spark)[0].collect()}
    first = got["d", "sec-4.1"]
    assert first.hay == "female aged 18 years or older. histologically confirmed hr-positive, her2-negative breast cancer dose 10 mg arm a tail"
    assert [(first.hay[b.start :].split()[0], b.page) for b in first.breaks] == [("female", 10), ("histologically", 11), ("dose", 14), ("arm", 14), ("tail", 11)]
    assert got["d", "sec-4.2"].hay == "known hypersensitivity to study drug." and got["d", "sec-4.3"].hay == "" and got["d", "sec-4.3"].breaks == []


def test_provenance_of_cited_moved_and_unfound_quotes(spark):
    cited = [
        (1, "d", "Female aged 18 years or older.", "sec-4.1", 0.9), (2, "d", "HR-positive, her2-negative   breast cancer", "sec-4.1", 1.7), (3, "d", "hypersensitivity to study drug", "sec-4.1", 0.95),
        (4, "d", "nothing of the kind is said anywhere", "sec-4.1", 0.95), (5, "d", None, "sec-4.2", 0.95), (6, "d", "", "sec-9", None), (7, "d", "dose | 10 mg", "t1", 0.8), (8, "e", "Female aged 18", "sec-4.1", 0.8),
        (9, "d", "Female aged 18", None, 0.8), (10, None, "Female aged 18", "sec-4.1", 0.8), (11, "d", "  ", "sec-4.1", 0.7),
    ]
    sections, tables = searched(spark)
    frame = spark.createDataFrame(cited, "k int, doc string, quote string, section string, confidence double")
    got = {r.k: (r.source_section, r.source_page, r.confidence, r.verified) for r in quotes.provenance(frame, ["k"], "doc", "quote", "section", "confidence", sections, "pos", tables).collect()}
    assert got == {
        1: ("sec-4.1", 10, 0.9, True), 2: ("sec-4.1", 11, 1.0, True), 3: ("sec-4.2", 12, 0.95, True), 4: ("sec-4.1", None, 0.3, False), 5: ("sec-4.2", None, 0.6, False), 6: (None, None, 0.0, False),
        7: ("sec-4.1", 14, 0.8, True), 8: ("sec-4.1", None, 0.3, False), 9: ("sec-4.1", 10, 0.8, True), 10: (None, None, 0.3, False), 11: ("sec-4.1", None, 0.3, False),
    }


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_the_query_equals_plain_python(spark):
    from recordloom.plans import document_queries as q

    hays, asked = {}, {}
    for r in q._sections(spark, FOLDER).collect():
        hays.setdefault(r.conv_id, []).append((r.turn, r.hay, r.breaks))
    got = QUERIES["q5_provenance"](spark, FOLDER).collect()
    ways = set()
    for r in got:
        needle = " ".join((r.quote or "").replace("|", " ").split()).lower()
        order = sorted(hays[r.conv_id], key=lambda s: (s[0] != r.turn, s[0]))
        want = next(((t, [b.page for b in breaks if b.start <= at][-1]) for t, hay, breaks in order if (at := plain_place(needle, hay)) >= 0), None)
        assert (r.source_section, r.source_page) == (want or (r.turn, None)) and r.verified == bool(want)
        assert r.confidence == (0.95 if want else 0.3 if r.quote else 0.6)
        ways.add((bool(want), bool(r.note), r.quote is None, "~" in (r.quote or "")))
    assert len(ways) >= 6
