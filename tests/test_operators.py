"""Operators by hand-made cases and against plain Python."""

import random

from pyspark.sql import functions as F

from recordloom.operators import layout, matching, review
from recordloom.sources import tables
from recordloom.streaming import review as revisions


def test_running_lines_need_the_band_or_many_pages(spark):
    rows = []
    for p in range(1, 7):
        rows += [("d", p, 0, "Protocol EX-001 Confidential", 30.0), ("d", p, 1, "Body line that repeats", 300.0), ("d", p, 2, f"Page {p} of 6", 770.0), ("d", p, 3, f"{p}. Chapter Title Number {p}", 60.0)]
    df = spark.createDataFrame(rows, "doc string, page int, idx int, text string, y double")
    got = {r.text for r in layout.running_lines(df, ["doc"], "page", "text", (F.col("y") + 10 <= 80) | (F.col("y") >= 712)).collect()}
    assert got == {"Protocol EX-001 Confidential", *(f"Page {p} of 6" for p in range(1, 7))}


def test_noise_contents_and_grids(spark):
    df = spark.createDataFrame([("CCI", 144.0), ("SCHEDULE OF ACTIVITIES", 16.0)], "text string, size double")
    assert [r[0] for r in df.select(layout.is_noise(F.col("size"), F.lit(12.0), F.col("text"))).collect()] == [True, False]
    rows = [(1, 0, "Table of Contents"), *((1, i, f"{i}. Part ........ {i}") for i in range(1, 7)), (2, 0, "1. Introduction"), (2, 1, "body")]
    pages = spark.createDataFrame(rows, "page int, nth int, text string")
    assert [r.page for r in layout.contents_pages(pages, ["page"], "text", "nth").collect()] == [1]
    soa = [["Procedure", "Screening", "Day 1", "Week 4"], ["Consent", "X", "", ""], ["Vitals", "X", "X", "X"]]
    dose = [["Level", "Dose"], ["1", "5 mg"], ["2", "10 mg"]]
    grids = spark.createDataFrame([(soa,), (dose,), ([["Header", None, None], ["a", "b", "c"]],)], "g array<array<string>>")
    got = grids.select(layout.schedule_score(F.col("g"), F.lit(False)).alias("s"), layout.grid_shape(F.col("g"))["merged"].alias("m")).collect()
    assert got[0].s >= 0.5 and got[1].s < 0.3 and got[2].m == 2
    tables = spark.createDataFrame([("d", 1, "t", 100.0)], "doc string, page int, id string, y double")
    lines = spark.createDataFrame([("d", 1, 70.0, "Table 1 Far"), ("d", 1, 90.0, "Table 2 Near"), ("d", 1, 95.0, "text")], "doc string, page int, y1 double, text string")
    assert layout.captions(tables, lines, ["doc", "page"], "id", "y", "y1", "text").first().caption == "Table 2 Near"


def test_best_pairs_equal_picking_one_by_one(spark):
    rng = random.Random(3)
    rows = [(u, i, j, rng.randrange(6) / 10) for u in range(4) for i in range(7) for j in range(6)]
    want, used = set(), set()
    for u, i, j, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if not {(u, "i", i), (u, "j", j)} & used:
            used |= {(u, "i", i), (u, "j", j)}
            want.add((u, i, j))
    got = matching.best_pairs(spark.createDataFrame(rows, "u int, i int, j int, score double"), ["u"])
    assert {(r.u, r.i, r.j) for r in got.collect()} == want


def test_a_table_against_itself_agrees(spark):
    rows = spark.createDataFrame([("s", i, f"Visit {i}", "Y") for i in range(5)], "u string, p int, name string, flag string")
    pairs = matching.best_pairs(matching.row_pairs(rows, rows, ["u"], "p", ["name", "flag"]), ["u"])
    assert {(r.i, r.j) for r in pairs.collect()} == {(i, i) for i in range(5)}
    t = matching.cell_tally(rows, rows, pairs, ["u"], "p", "name").first()
    assert t.gold == t.generated == t.matched == t.slots == 5
    less = rows.where("p <> 2")
    t = matching.cell_tally(less, rows, matching.best_pairs(matching.row_pairs(less, rows, ["u"], "p", ["name", "flag"]), ["u"]), ["u"], "p", "name").first()
    assert (t.gold, t.generated, t.matched, t.slots) == (4, 5, 4, 5)


def test_text_scores(spark):
    cases = [("01", "1"), ("Week 16", "Week 20"), ("Placebo", "Placebo Control Arm"), ("", "x")]
    got = {(r.a, r.b): r for r in matching.text_scores(spark.createDataFrame(cases, "a string, b string"), "a", "b").collect()}
    assert got["01", "1"].similarity == 1.0 and got["Week 16", "Week 20"].affinity < 0.5 and got["Placebo", "Placebo Control Arm"].affinity == 0.9 and got["", "x"].affinity == 0


def test_terms_near_a_phrase(spark):
    terms = spark.createDataFrame([("arm", "C174268", "Placebo Control Arm"), ("arm", "C174266", "Investigational Arm"), ("x", "C1", "placebo")], "list string, code string, text string")
    terms = terms.withColumn("synonyms", F.when(F.col("code") == "C174268", F.array(F.lit("Sham Intervention Arm"), F.lit(None))))
    asked = [("arm", "placebo"), ("arm", "double blind"), ("arm", " sham intervention  ARM"), ("arm", "c174266"), ("arm", "C1"), ("none", "placebo"), ("arm", None), ("arm", " "), (None, "placebo"), ("x", "Placebo")]
    got = matching.candidates(spark.createDataFrame(asked, "list string, phrase string"), "list", "phrase", terms, "code", ["text", "synonyms"]).collect()
    best = {(r.list, r.phrase): (r.code, r.status) for r in got if r.place in (1, None)}
    assert best["arm", "placebo"] == ("C174268", "fuzzy") and best["arm", "double blind"][1] == "unresolved" and best["arm", "C1"][1] == "unresolved"
    assert best["arm", " sham intervention  ARM"] == ("C174268", "exact") and best["arm", "c174266"] == ("C174266", "exact") and best["x", "Placebo"] == ("C1", "exact")
    assert best["none", "placebo"] == best[None, "placebo"] == (None, "unresolved") and best["arm", None] == best["arm", " "] == (None, None) and len(best) == len(asked)


def test_uploads_get_names_that_are_free(spark):
    files = [("s", "a.pdf", "1"), ("s", "a (2).pdf", "2"), ("s", "a.pdf", "3"), ("s", "a.pdf", "1"), ("s", "a.pdf", "5"), ("t", "a.pdf", "1"), ("s", "b.pdf", None), ("s", "b.pdf", "x"), (None, "a.pdf", "1"), ("s", "a (2).pdf", "9")]
    df = spark.createDataFrame([(*f, i) for i, f in enumerate(files)], "study string, n string, body string, at int")
    got = {r.at: (r.stored, r.copies) for r in tables.unique_uploads(df, "study", "n", "body", "at", ".pdf").collect()}
    assert got == {0: ("a.pdf", 2), 1: ("a (2).pdf", 1), 2: ("a (3).pdf", 1), 4: ("a (4).pdf", 1), 5: ("a.pdf", 1), 6: ("b.pdf", 1), 7: ("b (2).pdf", 1), 8: ("a.pdf", 1), 9: ("a (2) (2).pdf", 1)}
    raw = ["C:\\x\\My  Trial*é v1.PDF", "../..", "", "a/b/._ok_.pdf", "x" * 200]
    names = [r.y for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(tables.safe_file_name(F.col("r")).alias("y")).collect()]
    assert names == ["My Trial_ v1.pdf", "protocol.pdf", "protocol.pdf", "ok.pdf", "x" * 150 + ".pdf"]


def test_page_ends_of_deep_and_random_trees(spark):
    rng = random.Random(9)
    rows = [(d, i, rng.randint(1, 9), rng.choice([None, rng.randint(1, 40)])) for d in range(5) for i in range(30)]
    want = {}
    for d, i, level, end in rows:
        ends = [end]
        for _, _, deeper, e in rows[d * 30 + i + 1 : d * 30 + 30]:
            if deeper <= level:
                break
            ends.append(e)
        want[d, i] = max((e for e in ends if e is not None), default=None)
    got = layout.page_ends(spark.createDataFrame(rows, "d int, i int, level int, page int"), ["d"], "i", "level", "page").collect()
    assert {(r.d, r.i): r.page for r in got} == want


def test_names_are_unique_where_a_number_is_taken(spark):
    names = ["Placebo", "placebo", "Placebo", "Other", "placebo 2", "x" * 70, "X" * 70]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r.unique for r in review.unique_names(df.withColumn("s", F.lit(1)), ["s"], ["i"], "name").orderBy("i").collect()]
    assert len({x.lower() for x in got}) == len(names) and got[0] == "Placebo" and got[3] == "Other" and got[4] == "placebo 2" and max(map(len, got)) == 60


def test_revisions_of_tables_and_streams_are_the_same(spark, tmp_path):
    rows = [("a", 1, 0, True, 1), ("a", 2, 0, True, 1), ("a", 3, 1, True, 0), ("a", 4, 1, False, 2), ("a", 5, 1, True, 3), ("b", 1, 1, True, 1)]
    df = spark.createDataFrame(rows, revisions.SCHEMA)
    want = sorted(map(tuple, revisions.revisions(df).collect()))
    assert want == [("a", 1, True, 1), ("a", 2, False, 1), ("a", 3, True, 1), ("a", 4, False, 1), ("a", 5, True, 2), ("b", 1, False, 0)]
    df.coalesce(1).write.json(f"{tmp_path}/in")
    stream = revisions.revisions(spark.readStream.schema(revisions.SCHEMA).json(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("revised").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("revised").collect())) == want


def test_terms_are_ranked_for_a_query(spark):
    terms = [("l", "C2", "Female", ["F", "Woman"]), ("l", "C1", "Male", ["M", None]), ("l", "C3", "both", None), ("m", "C9", "Male", [])]
    frame = spark.createDataFrame(terms, "l string, code string, preferred string, synonyms array<string>")
    asked = spark.createDataFrame([("l", "woman"), ("l", " c3 "), ("l", None), ("l", ""), ("none", "x"), ("m", "female")], "l string, q string")
    got = {}
    for r in review.ranked_terms(asked, "l", "q", frame, "code", "preferred", ["preferred", "synonyms"]).orderBy("place").collect():
        got.setdefault((r.l, r.q), []).append((r.code, r.score))
    assert got["l", "woman"][0] == ("C2", 100.0) and got["l", " c3 "][0] == ("C3", 100.0) and [c for c, _ in got["l", None]] == [c for c, _ in got["l", ""]] == ["C3", "C2", "C1"]
    assert got["m", "female"] == [("C9", 80.0)] and ("none", "x") not in got and all(s == 0 for _, s in got["l", None])
