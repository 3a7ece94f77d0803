"""Alignment and scoring of generated tables against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions.text import items
from recordloom.operators import matching, scoring


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(10, 20)), max_size=9, unique_by=lambda p: p[:2]))
@settings(max_examples=300, deadline=None)
def test_ordered_alignment_is_the_best_of_all_non_crossing_ones(pairs):
    i, j, s = (np.array([p[k] for p in pairs]) for k in range(3))
    kept = scoring.non_crossing(i, j, s / 20)
    right = lambda c: all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(sorted(c)))
    total = lambda c: sum(p[2] / 20 - 0.45 for p in c)
    best = max(total(c) for r in range(len(pairs) + 1) for c in itertools.combinations(pairs, r) if right(c))
    mine = [pairs[k] for k in kept]
    assert right(mine) and abs(total(mine) - best) < 1e-9


def test_ordered_pairs_of_units(spark):
    rows = [("u", i, j, s) for i, j, s in [(0, 1, 0.9), (1, 0, 0.95), (1, 1, 0.5), (2, 2, 0.46), (0, 0, 0.6)]] + [("v", 3, 3, 0.5)]
    got = scoring.ordered_pairs(spark.createDataFrame(rows, "u string, i long, j long, score double"), ["u"]).collect()
    assert sorted((r.u, r.i, r.j) for r in got) == [("u", 1, 0), ("u", 2, 2), ("v", 3, 3)]
    assert scoring.ordered_pairs(spark.createDataFrame([], "u string, i long, j long, score double"), ["u"]).count() == 0


def test_items_keep_zeros_and_ones(spark):
    df = spark.createDataFrame([("0, 1 ,1,2,,02",)], "t string")
    assert df.select(items(F.col("t")).alias("x")).first().x == ["0", "1", "2", "02"]


def test_similarity_of_odd_texts(spark):
    pairs = [("東京", "大阪"), ("東京", "東京"), (None, None), (None, "a"), ("", "a"), ("Week 16 visit", "Week 20 visit"), ("cough count", "change in 24-hour cough count"), ("a_b c", "c a_b")]
    got = {(r.a, r.b): (round(r.similarity, 3), round(r.affinity, 3)) for r in matching.text_scores(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()}
    assert got["東京", "大阪"] == (0.0, 0.0) and got["東京", "東京"] == (1.0, 1.0) and got[None, None] == (1.0, 0.0) and got[None, "a"] == (0.0, 0.0)
    assert got["cough count", "change in 24-hour cough count"][1] == 0.9 and got["a_b c", "c a_b"][0] == 1.0
    assert len(got) == len(pairs) and got["Week 16 visit", "Week 20 visit"][1] < 0.5


LAYOUT = [
    {"unit": "arms", "header": "name", "tier": "identifier", "kind": "arm"}, {"unit": "arms", "header": "label", "tier": "text"}, {"unit": "arms", "header": "type", "tier": "code"},
    {"unit": "visits", "header": "name", "tier": "identifier", "kind": "visit", "ordered": True}, {"unit": "visits", "header": "label", "tier": "text"}, {"unit": "visits", "header": "next", "tier": "reference", "kind": "visit"},
    {"unit": "cells", "header": "arm", "tier": "reference", "kind": "arm", "scope": True, "literals": ["All"]}, {"unit": "cells", "header": "visits", "tier": "reference", "kind": "visit", "multi": True}, {"unit": "cells", "header": "dose", "tier": "value"},
]
CELLS = "study string, unit string, pos long, header string, value string"


def book(study, arms, visits, cells):
    rows = []
    for unit, table in (("arms", arms), ("visits", visits), ("cells", cells)):
        headers = [r["header"] for r in LAYOUT if r["unit"] == unit]
        rows += [(study, unit, i, h, v) for i, row in enumerate(table) for h, v in zip(headers, row, strict=True)]
    return rows


GOLD = book("s", [("Arm A", "Placebo once daily", "Placebo"), ("Arm B", "Active drug once daily", "Active")], [("V1", "Screening", "V2"), ("V2", "Week 4", "V3"), ("V3", "Week 8", None)], [("Arm A", "V1, V2", "0"), ("Arm B", "V1, V3", "10 mg"), ("All", "V2", "5 mg")])
MADE = book("s", [("X2", "active drug, once daily", "Active"), ("X1", "placebo once daily", "Placebo")], [("E1", "Screening visit", "E2"), ("E2", "Week 8", None)], [("X2", "E1, E2", "10.0 MG"), ("X1", "E1", "0"), ("All", "E7", "5 mg")])


def frames(spark, *books):
    return [spark.createDataFrame(b, CELLS) for b in books]


def layout(spark):
    return spark.createDataFrame([(r["unit"], r["header"], r["tier"], bool(r.get("multi")), r.get("kind"), r.get("literals") or [], bool(r.get("scope"))) for r in LAYOUT], "unit string, header string, tier string, multi boolean, kind string, literals array<string>, scope boolean")


def totals(spark, gold, made):
    pairs, names = scoring.aligned(gold, made, LAYOUT)
    found = scoring.tallies(gold, made, pairs, names, layout(spark)).collect()
    return {(r.unit, r.header): (r.gold, r.generated, r.matched, r.slots) for r in found}, {(r.unit, r.i, r.j) for r in pairs.collect()}, {(r.kind, r.made): r.gold for r in names.collect()}


def test_tables_are_aligned_through_learned_names(spark):
    got, pairs, names = totals(spark, *frames(spark, GOLD, MADE))
    assert pairs == {("arms", 0, 1), ("arms", 1, 0), ("visits", 0, 0), ("visits", 2, 1), ("cells", 0, 1), ("cells", 1, 0), ("cells", 2, 2)}
    assert names == {("arm", "x1"): "arm a", ("arm", "x2"): "arm b", ("visit", "e1"): "v1", ("visit", "e2"): "v3"}
    assert got["arms", "name"] == (2, 2, 0, 4) and got["arms", "label"] == (2, 2, 2, 2) and got["arms", "type"] == (2, 2, 2, 2)
    assert got["visits", "label"] == (3, 2, 1, 3) and got["visits", "next"] == (2, 1, 0, 3)
    assert got["cells", "arm"] == (3, 3, 3, 3) and got["cells", "visits"] == (5, 4, 3, 6) and got["cells", "dose"] == (3, 3, 3, 3)


def test_a_renamed_and_turned_book_scores_full(spark):
    renamed = [(s, u, 1 - p if u == "arms" else p, h, {"Arm A": "Q", "Arm B": "R", "V1": "W1", "V2": "W2", "V3": "W3", "V1, V2": "W1, W2", "V1, V3": "W1, W3"}.get(v, v)) for s, u, p, h, v in GOLD]
    for made in (renamed,):
        got, _, _ = totals(spark, *frames(spark, GOLD, made))
        assert all(g == m == k == s for (u, h), (g, m, k, s) in got.items() if h != "name")


def test_keys_by_tier(spark):
    cells = [("s", "arms", 0, "name", " Arm <b>A</b>"), ("s", "arms", 0, "type", "other = Sham"), ("s", "arms", 1, "type", "ACTIVE"), ("s", "cells", 0, "visits", "V2, V1,, V2"), ("s", "cells", 0, "dose", "01 Weeks"), ("s", "cells", 1, "dose", "  "), ("s", "none", 1, "x", "y"), (None, "cells", 0, "dose", "yes")]
    codes = spark.createDataFrame([("type", "Active", "C1"), ("dose", "yes", "C2")], "header string, text string, code string")
    got = scoring.with_keys(scoring.with_layout(frames(spark, cells)[0], layout(spark)), None, codes, {"BOTH": ["v1", "v2"]}).collect()
    assert {(r.study, r.unit, r.header, r.pos): r["keys"] for r in got} == {("s", "arms", "name", 0): ["arm a"], ("s", "arms", "type", 0): ["other=sham"], ("s", "arms", "type", 1): ["C1"], ("s", "cells", "visits", 0): ["BOTH"], ("s", "cells", "dose", 0): ["1 week"], (None, "cells", "dose", 0): ["y"]}


def test_best_pairs_and_scores_of_random_units_equal_plain_python(spark):
    rng = random.Random(6)
    table = lambda n: [(rng.choice(["N1", "N2", "N3"]), rng.choice(["alpha beta", "beta gamma", "delta", "alpha 5", None]), rng.choice(["Active", "Placebo", None])) for _ in range(n)]
    gold, made = book("s", table(5), [], []), book("s", table(6), [], [])
    a, b = frames(spark, gold, made)
    keyed = [scoring.with_keys(scoring.with_layout(x, layout(spark))) for x in (a, b)]
    sizes = spark.createDataFrame([("s", "arms", 5, 6)], "study string, unit string, n_gold long, n_made long")
    got = {(r.i, r.j): r.score for r in scoring.row_scores(*keyed, sizes, F.col("tier") != "identifier").collect()}
    texts = {(x, y) for _, _, _, h, x in gold if h == "label" and x for _, _, _, k, y in made if k == "label" and y}
    affinity = {(r.a, r.b): r.affinity for r in matching.text_scores(spark.createDataFrame(sorted(texts), "a string, b string"), "a", "b").collect()}
    cell = lambda rows, i: {h: v for _, _, p, h, v in rows if p == i and v}
    want = {}
    for i, j in itertools.product(range(5), range(6)):
        x, y = cell(gold, i), cell(made, j)
        alike = {h: affinity[x[h], y[h]] if h == "label" else float(x[h] == y[h]) for h in x.keys() & y.keys()}
        means = [np.mean(v) for v in ([s for h, s in alike.items() if h != "name"], list(alike.values())) if v]
        score = 0.85 * max(means, default=0.0) + 0.15 * (1 - abs(i / 4 - j / 5))
        if score >= 0.45:
            want[i, j] = score
    assert got == pytest.approx(want) and Counter(i for i, _ in got)


def test_many_units_are_aligned_as_each_alone(monkeypatch):
    rng = random.Random(6)
    units = []
    for u in range(400):
        n, m = rng.choice([(1, 1), (3, 4), (7, 7), (2, 9), (40, 45)]) if u % 11 else (0, 0)
        cells = [(i * rng.choice([1, 3]), j, rng.choice([9, 10, 12, 15, 20]) / 20) for i in range(n) for j in range(m) if rng.random() < 0.5]
        rng.shuffle(cells)
        units.append(list({c[:2]: c for c in cells}.values()))
    first = np.cumsum([0, *map(len, units)])
    i, j, score = (np.array([c[k] for u in units for c in u]) for k in range(3))
    monkeypatch.setattr(scoring, "CELLS", 1 << 14)
    got = scoring.non_crossing_units(first, i, j, score)
    for u, (a, b) in enumerate(itertools.pairwise(first)):
        assert list(np.flatnonzero(got[a:b])) == scoring.non_crossing(i[a:b], j[a:b], score[a:b]), (u, units[u])
    assert len(scoring.non_crossing_units(np.array([0]), i[:0], j[:0], score[:0])) == 0
