"""What queries hand on does not grow with the product of rows that are alike."""

import random

from pyspark.sql import functions as F

from recordloom import session
from recordloom.functions import fuzzy
from recordloom.operators import linking, matching, review, scoring
from recordloom.plans import QUERIES


def test_a_text_of_many_rows_is_met_by_two_of_them(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["large ring", "small ring", "large bolt", "blue bolt", "ring of steel"]
    entities = spark.createDataFrame([("s", rng.choice("ab"), i, f"N{i}", [rng.choice(texts)]) for i in range(200)], "study string, kind string, entity int, name string, texts array<string>")
    rows = [(k, "s", rng.choice([["a"], ["b"], ["a", "b"]]), rng.choice(["large ring", "bolt", "steel"]), True, 0.9) for k in range(60)]
    references = spark.createDataFrame(rows, "k int, study string, kinds array<string>, phrase string, extracted boolean, confidence double")
    seen, scored = [], linking.scored
    monkeypatch.setattr(linking, "scored", lambda *args: seen.append(args[2]) or scored(*args))
    got = linking.linked(references, ["k"], "study", "kinds", "phrase", "extracted", "confidence", entities)
    assert {(r.state, r.score) for r in got.collect()} == {("unclear", 100.0)}
    assert seen[0].groupBy("study", "kind", "text").count().agg(F.max("count")).first()[0] == 2


def test_rows_repeat_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(session, "REPEATS", 4)
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 5, 8, 30)], "x long").withColumn("n", F.col("x"))
    got = session.repeated(df, "n")
    assert {r.x: r["count"] for r in got.groupBy("x").count().collect()} == {1: 1, 3: 3, 4: 4, 5: 5, 8: 8, 30: 30} and got.columns == ["x"]


def test_texts_of_parts_are_scored_once(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    parts = [(rng.choice("AB"), rng.choice([1, 2, None]), rng.choice(["large ring", "ring large", "small bolt", "blue nut", None])) for _ in range(150)]
    spark.createDataFrame(parts, "p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = sorted((a, b) for x, m, a in parts for y, n, b in parts if m is not None and (x, m) == (y, n) and a and b and a < b)
    seen, scores = [], matching.text_scores
    monkeypatch.setattr(matching, "text_scores", lambda pairs, *on: seen.append(pairs.count()) or scores(pairs, *on))
    got = QUERIES["e2_text_scores"](spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in got.collect()) == want and seen == [len(set(want))]
    assert got.columns == ["a", "b", "similarity", "affinity"] and len(want) > 500


def test_terms_are_ranked_by_kinds(spark, monkeypatch):
    rng = random.Random(21)
    terms = [(rng.choice("LM"), i // 2 if i % 9 == 0 else i, rng.choice(["Ring", "ring", "Bolt", None]), rng.choice([["large"], ["small", "x"], [], None, ["12"]])) for i in range(240)]
    frame = spark.createDataFrame(terms, "l string, code long, preferred string, synonyms array<string>")
    asked = spark.createDataFrame([(x, q) for x in "LMN" for q in ("large ring", "12", "", None, "bolt", "100", "  RING ")], "l string, q string")
    monkeypatch.setattr(review, "PIECE", 7)
    seen, ratios = [], review.ratio
    monkeypatch.setattr(review, "ratio", lambda a, b: seen.append(1) or ratios(a, b))
    got = review.ranked_terms(asked, "l", "q", frame, "code", "preferred", ["preferred", "synonyms"]).collect()
    fold = lambda t: " ".join((t or "").lower().split())
    score = lambda q, t: round(max(fuzzy.plain_token_set(q, t), fuzzy.plain_ratio(q, t)), 1)
    for x in "LM":
        known = {}
        for own, code, preferred, synonyms in terms:
            if own == x:
                known.setdefault((code, preferred), []).extend(fold(t) for t in (preferred, *(synonyms or [])) if fold(t))
        for q in ("large ring", "12", "", None, "bolt", "100", "  RING "):
            each = [(100.0 if fold(q) and fold(q) == str(c) else max((score(fold(q), t) for t in ts if fold(q)), default=0.0), (p or "").lower(), c) for (c, p), ts in known.items()]
            want = sorted(each, key=lambda e: (-e[0], *e[1:]))
            rows = sorted((r for r in got if r.l == x and r.q == q), key=lambda r: r.place)
            assert [r.place for r in rows] == list(range(1, len(want) + 1))
            assert [(r.score, (r.preferred or "").lower(), r.code) for r in rows] == want
    assert {r.l for r in got} == {"L", "M"}


def test_ranking_sorts_no_row_of_the_result(spark):
    terms = spark.range(3000).select(F.lit("L").alias("l"), F.col("id").alias("code"), F.lit("Ring").alias("preferred"))
    asked = spark.createDataFrame([("L", f"ring {c}") for c in "abcdefghij"], "l string, q string")
    got = review.ranked_terms(asked, "l", "q", terms, "code", "preferred", ["preferred"])
    assert got.count() == 30000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "Window [row_number() windowspecdefinition(_set" in plan and "windowspecdefinition(l" not in plan


def test_tallies_write_texts_only(spark, monkeypatch):
    layout = spark.createDataFrame([("u", "t", "text", False, None, [], False), ("u", "c", "code", True, None, [], False), ("u", "r", "reference", False, "k", [], False), ("u", "v", "value", False, None, [], False)],
                                   "unit string, header string, tier string, multi boolean, kind string, literals array<string>, scope boolean")
    cells = lambda *rows: spark.createDataFrame([("s", "u", *r) for r in rows], "study string, unit string, pos long, header string, value string")
    gold = cells((0, "t", "Big ring"), (0, "c", "A, b,a"), (0, "r", "One"), (0, "v", "2 days"), (1, "t", "x"), (1, "c", " , "))
    made = cells((0, "t", "big  ring"), (0, "c", "b, d"), (0, "r", "uno"), (0, "v", "2.0 d"), (2, "c", "q"))
    names = spark.createDataFrame([("s", "k", "uno", "one")], "study string, kind string, made string, gold string")
    pairs = spark.createDataFrame([("s", "u", 0, 0)], "study string, unit string, i long, j long")
    kept = []
    monkeypatch.setattr(scoring, "saved", lambda df: kept.append(df.columns) or session.saved(df))
    got = {r.header: (r.gold, r.generated, r.matched, r.slots) for r in scoring.tallies(gold, made, pairs, names, layout).collect()}
    assert got == {"t": (2, 1, 1, 2), "c": (2, 3, 1, 4), "r": (1, 1, 1, 1), "v": (1, 1, 1, 1)}
    assert kept and not any({"_g", "_m"} & set(x) for x in kept)
