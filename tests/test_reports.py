"""Artefacts, timings and roll-ups by known cases."""

from pyspark.sql import functions as F

from recordloom.operators import reports, schedule
from recordloom.sources import artefacts


def test_one_broken_artefact_fails_nothing(spark, tmp_path):
    texts = ['{"study": "a",\n "versions": [{"n": 1}, {"n": null, "more": 2}]}', '{"study": "b", "versions": [', '{"study": "c", "other": true}', '{"study": "d", "versions": "no list"}', ""]
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(t)
    good, bad = artefacts.read_artefacts(spark, str(tmp_path), "study string, versions array<struct<n: int>>")
    assert {r.study: r.versions and [v.n for v in r.versions] for r in good.collect()} == {"a": [1, None], "c": None}
    assert sorted(r.file[-6] for r in bad.collect()) == ["1", "3"] and good.where("file like '%0.json'").count() == 1


def test_results_of_a_run_are_replaced_and_logs_are_not(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(rows, "study_id string, run_id int, v int")
    path = str(tmp_path / "r")
    artefacts.write_results(frame(("a", 1, 1), ("a", 2, 2), ("b", 1, 3)), path)
    artefacts.write_results(frame(("a", 2, 9)), path)
    read = lambda: sorted(tuple(r) for r in artefacts.read_results(spark, path, frame().schema).select("study_id", "run_id", "v").collect())
    assert read() == [("a", 1, 1), ("a", 2, 9), ("b", 1, 3)]
    artefacts.write_results(frame(("a", 2, 10)), path, append=True)
    assert read() == [("a", 1, 1), ("a", 2, 9), ("a", 2, 10), ("b", 1, 3)]


VISITS = "t string, pos int, key string, timepoint string, anchor boolean, offset_value string, unit string, direction string, win_before string, win_after string, win_unit string"


def test_timings_of_timelines(spark):
    rows = [
        ("main", 1, "v1", "Screening", False, "14", "days", "before", None, None, None), ("main", 2, "v2", "Day 1", True, None, None, None, "1", "1", "days"), ("main", 3, "v3", "Day 15", None, "14", "Days ", "after", "2", "2", "DAYS"),
        ("main", 4, "v4", "Week 8", False, "8", "weeks", "after", "7", None, "days"), ("main", 5, "v5", "Follow-up", False, None, None, None, None, None, None), ("main", 6, "v6", "Odd", False, "1.5", "weeks", "after", None, None, None), ("main", 7, "v7", "Dose", False, "3", "mg", "after", None, None, None),
        ("none", 1, "a", "A", False, "1", "day", "after", None, None, None), ("none", 2, "b", "B", None, "2", "days", "after", None, None, None), ("two", 1, "c", "C", False, "1", "day", "after", None, None, None), ("two", 2, "d", "D", True, "1", "day", "after", None, None, None), ("two", 3, "e", "E", True, "1", "day", "after", None, None, None),
    ]
    made = schedule.timings(spark.createDataFrame(rows, VISITS), ["t"], "pos")
    got = {r.key: (r.type, r.value, r.relative_to, r.window, bool(r.note)) for r in made.collect()}
    assert got == {
        "v1": ("Before", "14 days", "Day 1", None, False), "v2": ("Fixed Reference", "0 days", "Day 1", None, True), "v3": ("After", "14 days", "Day 1", "-2..2 days", False), "v4": ("After", "8 weeks", "Day 1", "-7..0 days", False),
        "v5": (None, None, None, None, True), "v6": (None, None, None, None, True), "v7": (None, None, None, None, True), "a": ("Fixed Reference", "0 days", "A", None, True), "b": (None, None, None, None, False),
        "c": (None, None, None, None, False), "d": ("Fixed Reference", "0 days", "D", None, True), "e": (None, None, None, None, False),
    }
    meetings = spark.createDataFrame([("v3", "E3"), ("v5", "E5"), ("a", "EA")], "visit string, encounter string")
    assert {r.encounter: r.scheduled_by for r in schedule.encounter_windows(meetings, made, "t", "main", "visit").collect()} == {"E3": "Day 15 timing", "E5": None, "EA": None}


def test_tables_are_finished_by_group(spark):
    rows = [("d", "g", 0.2, 4, 4, 0, 0.6, False, False), ("d", "g", 0.7, 3, 6, 2, 0.1, True, False), ("d", "h", 0.1, 3, 4, 0, 0.0, False, True), ("d", "i", 0.1, 3, 3, 0, 0.9, True, True), ("e", "g", 0.3, 2, 2, 0, 0.0, False, False)]
    done = reports.finished_tables(spark.createDataFrame(rows, "doc string, group_id string, score double, n_rows int, n_cols int, merged int, empty_ratio double, landscape boolean, under_schedule boolean"), "doc").collect()
    got = {(r.doc, r.group_id, r.n_rows): (r.group_score, r.schedule, r.reasons) for r in done}
    assert got == {
        ("d", "g", 4): (0.7, True, ["schedule_of_activities_candidate", "sparse_grid"]), ("d", "g", 3): (0.7, True, ["schedule_of_activities_candidate", "merged_cells", "landscape_wide_table"]),
        ("d", "h", 3): (0.6, True, ["schedule_of_activities_candidate"]), ("d", "i", 3): (0.1, False, []), ("e", "g", 2): (0.3, False, []),
    }


def test_rows_spans_and_releases(spark):
    cells = spark.createDataFrame([("b", "s", 1, "x"), ("b", "s", 1, "y"), ("b", "s", 2, " "), ("b", "s", 3, "z"), ("b", "t", 1, None)], "book string, sheet string, r int, text string")
    assert [tuple(r) for r in reports.rows_written(cells, ["book"], "sheet", "r").collect()] == [("b", "s", 2)]
    heads = spark.createDataFrame([("s", i, t) for i, t in ((1, "A"), (2, "A"), (4, "A"), (5, "B"), (6, None), (7, None), (8, "B"))], "s string, c int, t string")
    assert sorted(((r.t or "", r.first, r["last"]) for r in reports.header_spans(heads, ["s"], "c", "t").collect()), key=lambda x: x[1]) == [("A", 1, 2), ("A", 4, 4), ("B", 5, 5), ("", 6, 7), ("B", 8, 8)]
    runs = spark.createDataFrame([(1, "2024"), (2, "2025"), (3, None)], "run int, v string")
    assert [r.run for r in reports.other_releases(runs, "v", "2025").collect()] == [1]
    each, whole = reports.page_totals(spark.createDataFrame([("d", 1, "ab", True), ("d", 1, None, False)], "doc string, page int, text string, running boolean"), spark.createDataFrame([("d", 1, False, False), ("d", 2, True, True)], "doc string, page int, landscape boolean, contents boolean"), "doc", "page")
    assert tuple(whole.first()) == ("d", 2, 2, 2, 1, 1, [2]) and each.where(F.col("page") == 2).first().lines == 0
