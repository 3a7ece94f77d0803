"""Links of phrases and concepts against plain Python and known cases."""

import random
import re

from recordloom.functions import fuzzy
from recordloom.operators import linking

ENTITIES = "study string, kind string, entity int, name string, texts array<string>"
REFERENCES = "k int, study string, kinds array<string>, phrase string, extracted boolean, confidence double, literals array<string>"


def plain_score(phrase, texts):
    norm = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if w not in linking.STOPWORDS}
    best = 0.0
    for t in texts:
        a, b = words(phrase), words(t)
        cover = 100 * len(a & b) / min(len(a), len(b)) if a and b else 0.0
        best = max(best, cover, fuzzy.plain_token_set(norm(phrase), norm(t)))
    return best


def linked(spark, references, entities):
    frame = spark.createDataFrame(references, REFERENCES)
    return {r.k: r for r in linking.linked(frame, ["k"], "study", "kinds", "phrase", "extracted", "confidence", spark.createDataFrame(entities, ENTITIES), "literals").collect()}


def test_links_of_known_phrases(spark):
    entities = [("s", "endpoint", 1, "END1", ["Change in 24-hour cough count", "cough"]), ("s", "endpoint", 2, "END2", ["Overall survival"]), ("s", "endpoint", 3, "END3", ["Survival without progression"]), ("s", "arm", 4, "Arm A", None), ("t", "arm", 5, "Other", ["overall"])]
    rows = [
        (1, "s", ["endpoint"], "cough count", True, 0.9, None), (2, "s", ["endpoint"], "survival", True, 0.9, []), (3, "s", ["arm", "endpoint"], "Arm A", True, 0.9, None), (4, "s", ["endpoint"], "overall survival", False, 0.9, None),
        (5, "s", ["visit"], "cough", True, 0.9, None), (6, "s", ["endpoint"], "unrelated thing", True, 0.9, None), (7, "s", ["endpoint"], "cough count", True, 0.9, ["cough count"]), (8, "s", ["endpoint"], "  ", True, None, None),
        (9, "s", ["endpoint"], None, True, 0.5, None), (10, "s", ["arm", "endpoint"], "24-hour Cough Count", True, 1.0, None), (11, "t", ["endpoint"], "cough count", True, 1.0, None), (12, None, ["arm"], "Arm A", True, 1.0, None), (13, "s", None, "x", True, 1.0, None),
    ]
    got = linked(spark, rows, entities)
    assert {k: (r.value, r.state) for k, r in got.items()} == {
        1: ("END1", "linked"), 2: ("survival", "unclear"), 3: ("Arm A", "kept"), 4: ("overall survival", "kept"), 5: ("cough", "nothing"), 6: ("unrelated thing", "unclear"), 7: ("cough count", "kept"), 8: ("  ", "kept"),
        9: (None, "kept"), 10: ("END1", "linked"), 11: ("cough count", "nothing"), 12: ("Arm A", "nothing"), 13: ("x", "nothing"),
    }
    assert got[1].confidence == 0.9 and got[1].score == 100 and got[10].confidence == 1.0


def test_links_equal_trying_all_entities(spark):
    rng = random.Random(12)
    vocabulary = "cough count change from baseline week 12 survival overall progression free response rate tumour pain score daily diary 24-hour vital signs/temperature".split()
    say = lambda most: " ".join(rng.sample(vocabulary, rng.randint(1, most)))
    entities = [(rng.choice("st"), rng.choice(["a", "b"]), i, f"N{i}", [say(5) for _ in range(rng.randint(0, 3))]) for i in range(40)]
    rows = [(k, rng.choice("st"), rng.choice([["a"], ["b"], ["a", "b"]]), say(4), True, 0.95, None) for k in range(80)]
    got = linked(spark, rows, entities)
    states = set()
    for k, study, kinds, phrase, _, _, _ in rows:
        ranked = sorted(((plain_score(phrase, [n, *t]), n) for s, kind, _, n, t in entities if s == study and kind in kinds), reverse=True)
        first, second = ranked[0], ranked[1]
        link = first[0] >= 70 and first[0] - second[0] >= 5
        assert (got[k].value, got[k].state) == ((first[1], "linked") if link else (phrase, "unclear")), (phrase, ranked[:3])
        states.add(link)
        assert not link or got[k].confidence == round(min(0.95, first[0] / 100), 2)
    assert states == {True, False}


CONCEPTS = [("SYSBP", ["Systolic Blood Pressure", "SBP"]), ("DIABP", ["Diastolic Blood Pressure", "wbc"]), ("WBC", ["Leukocytes", "White cells"]), ("WBCU", ["White cells"]), ("AGE (TS)", ["Age"]), ("OLD [RETIRED]", ["Old"]), ("Temp, body", None)]


def test_concepts_by_name_and_by_their_own_synonyms(spark):
    concepts = spark.createDataFrame(CONCEPTS, "concept string, synonyms array<string>")
    asked = ["sysbp", " Systolic blood pressure ", "wbc", "white cells", "LEUKOCYTES", "temp, body", "none", "", None]
    got = {r.p: r.concept for r in linking.exact_concepts(spark.createDataFrame([(a,) for a in asked], "p string"), "p", concepts).collect()}
    assert got == {"sysbp": "SYSBP", " Systolic blood pressure ": "SYSBP", "wbc": "WBC", "white cells": None, "LEUKOCYTES": "WBC", "temp, body": "Temp, body", "none": None, "": None, None: None}


def test_activities_get_the_concepts_of_their_assessment(spark):
    concepts = spark.createDataFrame(CONCEPTS, "concept string, synonyms array<string>")
    measured = [("s", 1, "Vital signs", 1, "SBP", 0.9, True), ("s", 1, "Vital signs", 2, "Pulse", 0.9, True), ("s", 1, "Vital signs", 3, "diabp", 0.7, False), ("s", 1, "Vital signs", 4, "sysbp", 0.1, False),
                ("s", 2, "Physical Examination", 1, "Look", 0.9, True), ("s", 3, "Ophthalmic Examination", 1, None, 0.9, True), ("s", 4, "Demography", 1, "Age", 0.9, True), ("s", 4, "Demography", 2, "Temp, body", 0.5, True)]
    activities = [("s", "A1", "Vital Signs/Temperature"), ("s", "A2", "Physical Examination"), ("s", "A3", "Examination"), ("s", "Leukocytes", None), ("s", "A5", "Age"), ("t", "A6", "Vital signs"), ("s", "A7", "Demography")]
    got = linking.activity_concepts(spark.createDataFrame(activities, "study string, activity string, label string"), "study", "activity", "label", spark.createDataFrame(measured, "study string, assessment int, name string, nth int, value string, confidence double, verified boolean"), concepts)
    assert {r.activity: (r.concepts, r.state, r.missing, r.confidence, r.verified) for r in got.collect()} == {
        "A1": ("SYSBP, DIABP", "assessment", ["Pulse"], 0.7, False), "A2": (None, "none", ["Look"], None, None), "A3": (None, "open", [], None, None), "Leukocytes": ("WBC", "own", [], 0.8, True),
        "A5": (None, "open", [], None, None), "A6": (None, "open", [], None, None), "A7": ("Temp  body", "assessment", ["Age"], 0.5, True),
    }
