"""Edits of review documents: single cases, and streams that are cut anywhere against the table."""

import json
import random

import pytest

from recordloom.streaming import edits

LAYOUT = {
    "study": {"fields": ["title", "phase"], "prefix": "s", "rows": False, "codes": {"phase": {"C1": "Phase I", "C2": "Phase II"}}},
    "arms": {"fields": ["name", "label"], "prefix": "arm", "name": "name", "title": "arm"},
    "visits": {"fields": ["label"], "prefix": "v"},
}
BASE = [("study", 0, "title", "A study", None), ("study", 0, "phase", "Phase I", "C1"), ("arms", 0, "name", "Placebo", None), ("arms", 1, "name", "Drug", None), ("arms", 1, "label", "Active", None), ("visits", 0, "label", "Week 1", None), ("nothing", 0, "x", "y", None)]


def seed():
    return json.dumps([dict(zip(["sheet", "pos", "field", "value", "code"], b, strict=True)) for b in BASE])


def op(op, sheet=None, row_id=None, field=None, value=None, code=None, after=None, to=None, base=None):
    return {"op": op, "sheet": sheet, "row_id": row_id, "field": field, "value": value, "code": code, "after_row_id": after, "to_index": to, "base_revision": base}


@pytest.fixture
def book():
    b = edits.Book(LAYOUT)
    assert b.batch([op("set", "arms")])[0]["action"] == "rejected"
    assert b.batch([op("open", value=seed())]) == [{"action": "open"}] and b.state["revision"] == 0
    return b


def ids(book, sheet="arms"):
    return [r["id"] for r in book.state["sheets"][sheet]]


def test_values_and_codes(book):
    (e,) = book.batch([op("set", "study", field="phase", code="C2", base=0)])
    assert (e["cell"], e["old_value"], e["new_value"], e["old_code"], e["new_code"], book.state["revision"]) == ("study!B2", "Phase I", "Phase II", "C1", "C2", 1)
    assert book.batch([op("set", "study", field="phase", code="C1", base=0)])[0]["action"] == "conflict" and book.state["revision"] == 1
    assert book.batch([op("set", "study", field="phase", value=" phase ii ", base=1)])[0]["new_value"] == "phase ii"
    assert book.batch([op("set", "study", field="title", value="A study")]) == [] and book.state["revision"] == 2
    for wrong in (op("set", "study", field="phase", code="C9"), op("set", "study", field="title", code="C1"), op("set", "none", field="x"), op("set", "arms", "arm-9", "name"), op("set", "arms", "arm-1", "none"), op("fly", "arms")):
        assert book.batch([op("set", "arms", "arm-1", "label", "lost"), wrong])[0]["action"] == "rejected"
    assert book.state["revision"] == 2 and "label" not in book.state["sheets"]["arms"][0]["cells"]


def test_rows_are_added_moved_and_deleted(book):
    (a,) = book.batch([op("add_row", "arms", after="arm-1")])
    assert (a["row_id"], a["new_value"], a["cell"], ids(book)) == ("arm-3", "New arm", "arms!3:3", ["arm-1", "arm-3", "arm-2"])
    (b,) = book.batch([op("add_row", "arms")])
    assert b["new_value"] == "New arm 2" and ids(book) == ["arm-4", "arm-1", "arm-3", "arm-2"]
    assert book.batch([op("move_row", "arms", "arm-4", to=99)])[0]["detail"] == "moved from row 2 to row 5" and ids(book)[-1] == "arm-4"
    assert book.batch([op("move_row", "arms", "arm-4", to=3)]) == []
    (d,) = book.batch([op("delete_row", "arms", "arm-2")])
    assert json.loads(d["old_value"]) == {"name": "Drug", "label": "Active"} and ids(book) == ["arm-1", "arm-3", "arm-4"]
    assert book.batch([op("add_row", "arms")])[0]["row_id"] == "arm-5"
    for wrong in (op("add_row", "study"), op("delete_row", "study"), op("delete_row", "arms", "arm-2"), op("add_row", "arms", after="arm-2"), op("move_row", "arms", "arm-1", to=-1), op("move_row", "arms", "arm-1")):
        assert book.batch([wrong])[0]["action"] == "rejected"
    assert book.batch([op("add_row", "visits")])[0]["new_value"] is None


def test_accepting_confirming_and_restarting(book):
    assert [e["action"] for e in book.batch([op("accept", "arms", "arm-1", "name")])] == ["accept"] and book.batch([op("accept", "arms", "arm-1", "name")]) == []
    book.batch([op("set", "arms", "arm-1", "name", "Other")])
    assert book.batch([op("accept", "arms", "arm-1", "name")])[0]["action"] == "rejected" and book.batch([op("accept", "arms", "arm-1", "label")])[0]["action"] == "rejected"
    assert book.batch([op("confirm", base=2)])[0]["action"] == "confirm" and book.state["status"] == "confirmed"
    assert [e["action"] for e in book.batch([op("delete_row", "arms", "arm-2")])] == ["reopen", "delete_row"] and book.state["status"] == "draft"
    (r,) = book.batch([op("restart", value=seed(), base=4)])
    assert json.loads(r["old_value"])["revision"] == 4 and book.state["revision"] == 5 and ids(book) == ["arm-1", "arm-2"]
    assert book.batch([op("open", value=seed())])[0]["action"] == "rejected"


def operations(rng, runs=3, batches=25):
    rows, kinds = [], ["set", "set", "accept", "add_row", "delete_row", "move_row", "confirm"]
    for run in range(runs):
        rows.append((f"r{run}", 0, 0, None, "open", None, None, None, seed(), None, None, None))
        for batch in range(1, batches):
            for seq in range(rng.randint(1, 3)):
                kind = rng.choice(kinds) if seq else rng.choice([*kinds, "restart"] if batch % 9 == 0 else kinds)
                sheet = rng.choice(["arms", "arms", "visits", "study"])
                row = f"{LAYOUT[sheet]['prefix']}-{rng.randint(1, 4)}"
                rows.append((f"r{run}", batch, seq, rng.choice([None, None, rng.randint(0, batch)]), kind, sheet, row, rng.choice(LAYOUT[sheet]["fields"]), seed() if kind == "restart" else rng.choice(["a", "b", None]), None, rng.choice([None, row]), rng.randint(0, 3)))
    return rows


def test_a_stream_cut_anywhere_equals_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = operations(rng)
    table = spark.createDataFrame(rows, edits.OPERATIONS)
    want = sorted(map(tuple, edits.audited(table, LAYOUT).collect()), key=repr)
    assert {w[4] for w in want} >= {"open", "set", "add_row", "delete_row", "move_row", "rejected", "conflict", "confirm", "reopen"}
    cuts = sorted(rng.sample(range(1, 25), 3))
    parts = [[r for r in rows if low <= r[1] < high] for low, high in zip([0, *cuts], [*cuts, 99], strict=True)]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, edits.OPERATIONS).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(edits.OPERATIONS + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    edits.audited(stream, LAYOUT).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.schema(edits.AUDIT).parquet(str(tmp_path / "out")).collect()), key=repr) == want


def test_documents_after_all_operations(spark):
    cells = spark.createDataFrame([("r", *b) for b in BASE], "run_id string, sheet string, pos int, field string, value string, code string")
    more = [("r", 1, 0, 0, "set", "arms", "arm-2", "label", "New", None, None, None), ("r", 2, 0, 1, "move_row", "arms", "arm-2", None, None, None, None, 0)]
    ops = edits.opened(cells).unionByName(spark.createDataFrame(more, edits.OPERATIONS))
    got = {(r.sheet, r.pos, r.field): (r.row_id, r.value, r.origin) for r in edits.documents(ops, LAYOUT).collect()}
    assert got["arms", 0, "label"] == ("arm-2", "New", "human") and got["arms", 1, "name"] == ("arm-1", "Placebo", "extracted") and got["arms", 1, "label"] == ("arm-1", None, "empty") and len(got) == 7
    assert edits.audited(ops.limit(0), LAYOUT).count() == 0
