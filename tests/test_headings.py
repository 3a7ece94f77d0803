"""Rows, headings, the numbered outline and bookmarks against plain Python and known cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.functions import fuzzy
from recordloom.operators import headings as h

PROGRESSIONS = [
    ((1,), (1, 1), True), ((1, 2), (1, 2, 2), True), ((1, 2), (1, 2, 1, 1), True), ((1, 1), (1, 2), True), ((1, 2, 4, 3), (2,), True), ((5, 3, 4), (5, 4), True),
    ((9,), (9, 2), True), ((2,), (2,), False), ((5,), (3,), False), ((1,), (7,), False), ((1, 1), (1, 1, 9), False),
]


def follows(before, number):
    return any(before[: len(p)] == p if prefix else before == p for p, prefix in h.predecessors(number))


@pytest.mark.parametrize(("before", "number", "fine"), PROGRESSIONS)
def test_progressions(before, number, fine):
    assert follows(before, number) == fine


def test_a_list_item_does_not_displace_a_chapter():
    numbers = [(1,), (1, 1), (3,), (2,), (2, 1), (3,), (3, 1)]
    assert h.best_chain(numbers, [1.0] * 7) == [True, True, False, True, True, True, True]
    assert h.best_chain([(1,), (2,), (1, 1), (1, 2), (2,)], [2.0, 0.5, 2.0, 2.0, 2.0]) == [True, False, True, True, True]
    assert h.best_chain([(9,), (7,)], [1.0, 1.0]) == [False, False] and h.best_chain([], []) == []


NUMBER = st.lists(st.integers(1, 4), min_size=1, max_size=3).map(tuple)


@given(st.lists(st.tuples(NUMBER, st.sampled_from([0.5, 1.0, 1.5, 2.0])), max_size=9))
@settings(max_examples=300, deadline=None)
def test_the_chain_is_the_heaviest_of_all_subsequences(candidates):
    numbers, weights = [c[0] for c in candidates], [c[1] for c in candidates]
    kept = h.best_chain(numbers, weights)
    chain = [n for n, k in zip(numbers, kept, strict=True) if k]
    right = lambda c: not c or h.may_start(c[0]) and all(itertools.starmap(follows, itertools.pairwise(c)))
    best = max(sum(weights[i] for i in c) for r in range(len(numbers) + 1) for c in itertools.combinations(range(len(numbers)), r) if right([numbers[i] for i in c]))
    assert right(chain) and sum(w for w, k in zip(weights, kept, strict=True) if k) == best


def test_chains_of_documents(spark):
    rows = [(d, i, n, 1.0) for d, numbers in {"x": "1 1.1 3 2 2.1 3 3.1".split(), "y": ["9"], "z": ["1", "2"]}.items() for i, n in enumerate(numbers)]
    got = h.outline_chain(spark.createDataFrame(rows[::-1], "doc string, pos int, number string, weight double"), "doc", ["pos"])
    assert {(r.doc, r.pos) for r in got.collect() if not r.kept} == {("x", 2), ("y", 0)} and got.count() == 10


def test_rows_of_fragments(spark):
    rng = random.Random(2)
    rows = [(p, f"w{i}", float(rng.randint(0, 200)) / 2, y := rng.randint(0, 120) / 2, 0.0, y + rng.choice([0.0, 4.0, 6.5, 10.0]), rng.choice([8.0, 10.0, 12.0]), rng.choice([0.0, 1.0, 0.5])) for p in range(6) for i in range(30)]
    rows = [(p, t, x, y, x + 5, z, s, b) for p, t, x, y, _, z, s, b in rows]
    want = []
    for p in range(6):
        groups = []
        for f in sorted((r for r in rows if r[0] == p), key=lambda r: (round(r[3]), r[2], r[3], r[4], r[1])):
            last = groups[-1][-1] if groups else None
            if last and min(f[5], last[5]) - max(f[3], last[3]) >= 0.6 * (min(f[5] - f[3], last[5] - last[3]) or 1.0):
                groups[-1].append(f)
            else:
                groups.append([f])
        for i, g in enumerate(groups):
            total = sum(len(f[1]) for f in g)
            want.append((p, i, " ".join(f[1] for f in sorted(g, key=lambda f: f[2])), min(f[2] for f in g), min(f[3] for f in g), max(f[4] for f in g), max(f[5] for f in g),
                         round(sum(f[6] * len(f[1]) for f in g) / total, 2), sum(f[7] * len(f[1]) for f in g) / total >= 0.6))
    got = h.visual_rows(spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold double"), ["page"]).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and any(" " in r[2] for r in want)


def test_lines_outside_tables_equal_plain_search(spark):
    rng = random.Random(4)
    box = lambda wide, high: (x := rng.uniform(-50, 500), y := rng.uniform(-50, 700), x + rng.uniform(0, wide), y + rng.uniform(0, high))
    lines, tables = [(i % 5, i, *box(300, 12)) for i in range(400)], [(i % 4, *box(250, 250)) for i in range(14)]
    lines += [(1, 1000, None, 1.0, None, 2.0), (None, 1001, 0.0, 0.0, 1.0, 1.0)]
    out = lambda r: r[2] is None or not any(t[0] == r[0] and t[1] - 2 <= (r[2] + r[4]) / 2 <= t[3] + 2 and t[2] - 2 <= (r[3] + r[5]) / 2 <= t[4] + 2 for t in tables)
    boxes = "x0 double, y0 double, x1 double, y1 double"
    got = h.outside_tables(spark.createDataFrame(lines, f"page int, i int, {boxes}"), ["page"], spark.createDataFrame(tables, f"page int, {boxes}"))
    assert sorted(r.i for r in got.collect()) == sorted(r[1] for r in lines if out(r)) and 50 < got.count() < 400


LINES = "doc string, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, body double, edge double, width double"


def line(page, idx, text, x1=200.0, size=10.0, bold=False, x0=72.0):
    return ("d", page, idx, text, x0, 20.0 * idx, x1, 20.0 * idx + 12, size, bold, 10.0, 420.0, 600.0)


DOCUMENT = [
    line(1, 0, "A Study of One Thing in Another Thing", size=16.0), line(2, 0, "PROTOCOL SUMMARY", bold=True), line(2, 1, "AND MORE", bold=True), line(2, 2, "text"), line(2, 3, "A STUDY OF ONE THING IN ANOTHER", bold=True), line(3, 0, "PROTOCOL SUMMARY", bold=True),
    line(3, 2, "PROTOCOL SUMMARY", bold=True), line(4, 0, "1. Introduction", bold=True), line(4, 1, "SHOUTED INSIDE", bold=True), line(4, 2, "1.1 A title that is so long that it wraps at the", x1=415.0, bold=True), line(4, 3, "edge of the page", bold=True),
    line(4, 4, "Bold but another thing", bold=True), line(4, 5, "3. Patients must be bold", bold=True), line(5, 0, "02 Objectives", size=14.0), line(5, 1, "2.1 ends in a stop.", bold=True), line(5, 2, "99 Too high a chapter", bold=True),
    line(5, 3, "3 Not styled"), line(5, 5, "3. Design", bold=True), line(6, 0, "Appendix 2. Hachinski Scale", bold=True), line(6, 1, "4. Orientation", bold=True), line(7, 0, "Appendix 2", bold=True), line(7, 1, "Hachinski Scale continued", bold=True),
    line(8, 0, "Protocol Attachment LZZT.1", bold=True), line(8, 1, "Wrapped title", bold=True), line(9, 0, "1. In contents", bold=True),
]


def test_headings_of_a_document(spark):
    found, rejected = h.detected(spark.createDataFrame(DOCUMENT, LINES), "doc", "page", "width", spark.createDataFrame([("d", 9)], "doc string, page int"))
    got = [(r.page, r.number, r.kind, r.title, r.extra) for r in found.orderBy("page", "y0").collect()]
    assert got == [
        (2, None, "front", "PROTOCOL SUMMARY AND MORE", 1), (3, None, "front", "PROTOCOL SUMMARY", 0), (4, "1", "body", "Introduction", 0), (4, "1.1", "body", "A title that is so long that it wraps at the edge of the page", 1),
        (5, "2", "body", "Objectives", 0), (5, "3", "body", "Design", 0), (6, None, "appendix", "Appendix 2. Hachinski Scale", 0), (8, None, "appendix", "Protocol Attachment LZZT.1. Wrapped title", 1),
    ]
    assert [(r.number, r.page) for r in rejected.collect()] == [("3", 4)]


def test_repeated_headings_are_compared_with_the_last_kept(spark):
    rows = [("d", 1, "Arms", None), ("d", 2, "ARMS", None), ("d", 3, "Arms", None), ("d", 4, "Arms", "1"), ("d", 4, "Arms.", None), ("d", 9, "Arms", None), ("e", 9, "Arms", None)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc string, page int, title string, number string, i int")
    assert sorted(r.i for r in h.without_continuations(frame, ["doc"], ["i"], "title", "page", "number").collect()) == [0, 2, 3, 5, 6]


def plain_reconciled(marks, heads, lines, n_pages):
    """What each bookmark does, one after the other."""
    import re

    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    added, out = [], {}
    for pos, title, page in marks:
        m = re.match(r"^(\d{1,2}(?:\.\d{1,3}){0,5})\.?\s+(.*)$", title)
        number, bare = (m[1], m[2].strip()) if m else (None, title.strip())
        if re.search(h.SKIPPED, title) or not 1 <= page <= n_pages:
            out[pos] = ("skipped", None, None)
            continue
        agrees = lambda x: abs(x[0] - page) <= 1 and (x[4] == number and fuzzy.plain_partial(norm(x[3]), norm(bare)) >= 80 if number else fuzzy.plain_ratio(norm(x[3]), norm(bare)) >= 85)  # noqa: B023, E731
        hit = next((x for x in heads if agrees(x)), None)
        late = next((x for x in added if agrees(x)), None)
        row = next((r for r in lines if r[0] == page and len(r[2]) < 170 and fuzzy.plain_partial(norm(bare), norm(r[2])) >= 92), None)
        if hit:
            out[pos] = ("matched", hit[0], hit[1])
        elif late:
            out[pos] = ("repeats", None, None)
        elif number is None and row is None:
            out[pos] = ("lost", None, None)
        else:
            added.append((page, row[1] if row else -1, 0.0, bare, number))
            out[pos] = ("added", page, row[1] if row else -1)
    return out


def test_bookmarks_equal_going_through_them_one_by_one(spark):
    rng = random.Random(8)
    words = "aims design scope dose arms safety table contents visits".split()
    title = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4))).capitalize()
    heads, marks, lines = [], [], []
    for page in range(1, 11):
        for i in range(4):
            text = title()
            lines.append((page, i, text if rng.random() < 0.8 else ""))
            if rng.random() < 0.5:
                heads.append((page, i, float(i), text, f"{page}.{i}" if rng.random() < 0.5 else None))
    for pos in range(60):
        page, number, text = rng.choice(heads)[0::4] + (None,) if False else (lambda x: (x[0], x[4], x[3]))(rng.choice(heads))
        text = text if rng.random() < 0.5 else rng.choice(lines)[2] if rng.random() < 0.5 else title()
        marks.append((pos, f"{number} {text}" if number and rng.random() < 0.8 else text, page + rng.choice([-2, -1, 0, 0, 1, 30])))
    frame = lambda rows, schema: spark.createDataFrame([("d", *r) for r in rows], f"doc string, {schema}")
    got = h.reconciled(
        frame(marks, "pos long, title string, page int"), frame(heads, "page int, idx int, y0 double, title string, number string"), frame([(p, i, float(i), t) for p, i, t in lines], "page int, idx int, y0 double, text string"),
        frame([(10,)], "n_pages int"), "doc", "page",
    )
    want = plain_reconciled(marks, heads, lines, 10)
    assert {r.pos: (r.state, r.heading_page, r.idx) for r in got.collect()} == want and len({w[0] for w in want.values()}) >= 4


def test_section_names(spark):
    rows = [("d", i, n, k, t) for i, (n, k, t) in enumerate([("3.4", "body", "A"), (None, "appendix", "Appendix 1. X"), ("3.4", "body", "B"), (None, "front", "A 2"), (None, "front", "A"), (None, "front", "A"), (None, "front", "é"), (None, "appendix", "")])]
    got = h.section_ids(spark.createDataFrame(rows, "doc string, i int, number string, kind string, title string"), "doc", ["i"]).orderBy("i").collect()
    assert [r.section_id for r in got] == ["sec-3.4", "app-appendix-1-x", "sec-3.4-2", "fm-a-2", "fm-a", "fm-a-3", "fm-section", "app-appendix"]


def test_partial_and_weighted_ratios():
    assert fuzzy.plain_partial("abc", "xxabcxx") == 100 and fuzzy.plain_partial("", "") == 100 and fuzzy.plain_partial("a", "") == 0
    assert fuzzy.plain_weighted("wbc", "wbc") == 100 and fuzzy.plain_weighted("abc", "abc def ghi jkl mno") == 90 and fuzzy.plain_weighted("", "x") == 0
    assert round(fuzzy.plain_weighted("new york mets", "new york yankees"), 2) == round(max(fuzzy.plain_ratio("new york mets", "new york yankees"), 0.95 * fuzzy.plain_token_set("new york mets", "new york yankees")), 2)
