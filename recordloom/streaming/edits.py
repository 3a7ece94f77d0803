"""Review documents under edits: rows added, moved, deleted, values set and accepted, in atomic batches, as a table and as a stream.

A document has sheets of rows, in order. The layout says, by sheet: `fields` (in order), `prefix` (of row ids), `rows` (false: one record that cannot be added to, moved or
deleted), `name` (the field that names a row, if any), `title` (singular, for names of new rows) and `codes` (field to {code: preferred term}).
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import importable

OPERATIONS = "run_id string, batch_id long, seq long, base_revision long, op string, sheet string, row_id string, field string, value string, code string, after_row_id string, to_index long"
AUDIT = "run_id string, batch_id long, nth long, revision long, action string, sheet string, cell string, row_id string, field string, old_value string, new_value string, old_code string, new_code string, detail string"
CELLS = "run_id string, revision long, status string, sheet string, pos long, row_id string, field string, value string, code string, origin string, accepted boolean"


class Refused(Exception):
    """An operation that cannot be: its batch leaves no trace in the document."""


def _letter(n: int) -> str:
    return (chr(64 + n // 26) if n >= 26 else "") + chr(65 + n % 26)


class Book:
    """One run's document; everything it knows is in `state`, which is plain JSON."""

    def __init__(self, layout: dict[str, dict], state: dict | None = None) -> None:
        self.layout = layout
        self.state = state or {"revision": None, "status": None, "sheets": {}, "next": {}}

    def seed(self, base: list[dict], revision: int) -> None:
        """Begins anew from base (sheet, pos, field, value, code): fresh row ids, everything as extracted."""
        self.state = {"revision": revision, "status": "draft", "sheets": {}, "next": {}}
        rows: dict[tuple[str, int], dict] = {}
        for cell in sorted(base, key=lambda c: (c["sheet"], c["pos"])):
            if cell["sheet"] not in self.layout or cell["field"] not in self.layout[cell["sheet"]]["fields"]:
                continue
            at = (cell["sheet"], cell["pos"])
            if at not in rows:
                rows[at] = {"id": self._fresh(cell["sheet"]), "cells": {}}
                self.state["sheets"].setdefault(cell["sheet"], []).append(rows[at])
            rows[at]["cells"][cell["field"]] = [cell["value"], cell.get("code"), "extracted", False]

    def _fresh(self, sheet: str) -> str:
        prefix = self.layout[sheet]["prefix"]
        n = self.state["next"].get(prefix, 1)
        self.state["next"][prefix] = n + 1
        return f"{prefix}-{n}"

    def _rows(self, sheet: str) -> list[dict]:
        if not self.layout[sheet].get("rows", True):
            raise Refused(f"{sheet} has no rows to add, delete or move")
        return self.state["sheets"].setdefault(sheet, [])

    def _row(self, sheet: str, row_id: str | None) -> tuple[dict, int]:
        rows = self.state["sheets"].get(sheet, [])
        if not self.layout[sheet].get("rows", True):
            if not rows:
                raise Refused(f"there is no {sheet} record")
            return rows[0], 0
        for at, row in enumerate(rows):
            if row["id"] == row_id:
                return row, at
        raise Refused(f"row {row_id} not found in {sheet}")

    def _cell(self, sheet: str, field: str, at: int) -> str:
        n = self.layout[sheet]["fields"].index(field)
        return f"{sheet}!{_letter(n)}{at + 2}" if self.layout[sheet].get("rows", True) else f"{sheet}!B{n + 1}"

    def _field(self, sheet: str, field: str | None) -> str:
        if field not in self.layout[sheet]["fields"]:
            raise Refused(f"{sheet} has no field {field}")
        return field

    def set(self, o: dict) -> dict | None:
        sheet, field = o["sheet"], self._field(o["sheet"], o["field"])
        row, at = self._row(sheet, o["row_id"])
        terms = self.layout[sheet].get("codes", {}).get(field)
        value, code = (o["value"] or "").strip() or None, o["code"]
        if code is not None:
            if terms is None or code not in terms:
                raise Refused(f"{code} is not a term of {field}")
            value = value or terms[code]
        elif terms and value:
            code = next((c for c, t in terms.items() if t.casefold() == value.casefold()), None)
        old = row["cells"].get(field, [None, None, "empty", False])
        if (value, code) == (old[0], old[1]):
            return None
        row["cells"][field] = [value, code, "human", False]
        return {"cell": self._cell(sheet, field, at), "old_value": old[0], "new_value": value, "old_code": old[1], "new_code": code}

    def accept(self, o: dict) -> dict | None:
        row, at = self._row(o["sheet"], o["row_id"])
        cell = row["cells"].get(self._field(o["sheet"], o["field"]))
        if not cell or cell[2] != "extracted":
            raise Refused("only extracted values can be accepted")
        if cell[3]:
            return None
        cell[3] = True
        return {"cell": self._cell(o["sheet"], o["field"], at), "old_value": cell[0], "new_value": cell[0]}

    def _placeholder(self, sheet: str) -> str | None:
        """A name that no row of the sheet bears, whatever its case."""
        field = self.layout[sheet].get("name")
        if not field:
            return None
        taken = {(r["cells"].get(field) or [""])[0] for r in self.state["sheets"].get(sheet, [])}
        taken = {(t or "").casefold() for t in taken}
        name = base = f"New {self.layout[sheet].get('title', sheet)}"[:60]
        n = 2
        while name.casefold() in taken:
            name, n = f"{base[: 59 - len(str(n))]} {n}", n + 1
        return name

    def add_row(self, o: dict) -> dict:
        rows, at = self._rows(o["sheet"]), 0
        if o["after_row_id"] is not None:
            at = self._row(o["sheet"], o["after_row_id"])[1] + 1
        name = self._placeholder(o["sheet"])
        row = {"id": self._fresh(o["sheet"]), "cells": {self.layout[o["sheet"]]["name"]: [name, None, "derived", False]} if name else {}}
        rows.insert(at, row)
        return {"cell": f"{o['sheet']}!{at + 2}:{at + 2}", "row_id": row["id"], "new_value": name}

    def delete_row(self, o: dict) -> dict:
        rows = self._rows(o["sheet"])
        row, at = self._row(o["sheet"], o["row_id"])
        rows.pop(at)
        values = {f: (row["cells"].get(f) or [None])[0] for f in self.layout[o["sheet"]]["fields"]}
        return {"cell": f"{o['sheet']}!{at + 2}:{at + 2}", "old_value": json.dumps(values, ensure_ascii=False)}

    def move_row(self, o: dict) -> dict | None:
        rows, (_, at) = self._rows(o["sheet"]), self._row(o["sheet"], o["row_id"])
        if o["to_index"] is None or o["to_index"] < 0:
            raise Refused("no row to move to")
        to = min(int(o["to_index"]), len(rows) - 1)
        if to == at:
            return None
        rows.insert(to, rows.pop(at))
        return {"cell": f"{o['sheet']}!{to + 2}:{to + 2}", "detail": f"moved from row {at + 2} to row {to + 2}"}

    def batch(self, operations: list[dict]) -> list[dict]:
        """What a batch does, as audit entries: all of it, or, if anything in it cannot be, nothing but the reason."""
        kept, revision, base = json.dumps(self.state), self.state["revision"], operations[0]["base_revision"]
        first = operations[0]["op"]
        if first == "open":
            if revision is not None:
                return [{"action": "rejected", "detail": "the review is open"}]
            self.seed(json.loads(operations[0]["value"] or "[]"), 0)
            return [{"action": "open"}]
        if revision is None:
            return [{"action": "rejected", "detail": "open the review first"}]
        if base is not None and base != revision:
            return [{"action": "conflict", "detail": f"made against revision {base}, now {revision}"}]
        if first in ("confirm", "restart"):
            if first == "restart":
                self.seed(json.loads(operations[0]["value"] or "[]"), revision + 1)
                return [{"action": "restart", "old_value": kept, "detail": f"revision {revision} archived"}]
            self.state |= {"revision": revision + 1, "status": "confirmed"}
            return [{"action": "confirm"}]
        entries = []
        try:
            for o in operations:
                if o["op"] not in ("set", "accept", "add_row", "delete_row", "move_row") or o["sheet"] not in self.layout:
                    raise Refused(f"no operation {o['op']} on {o['sheet']}")
                if done := getattr(self, o["op"])(o):
                    entries.append({"action": o["op"], "sheet": o["sheet"], "row_id": o["row_id"], "field": o["field"] if o["op"] in ("set", "accept") else None} | done)
        except Refused as why:
            self.state = json.loads(kept)
            return [{"action": "rejected", "detail": str(why)}]
        if entries:
            self.state["revision"] = revision + 1
            if self.state["status"] == "confirmed":
                self.state["status"] = "draft"
                entries.insert(0, {"action": "reopen", "detail": "edited after confirmation"})
        return entries

    def cells(self) -> list[tuple]:
        s = self.state
        return [(s["revision"], s["status"], sheet, pos, row["id"], field, *row["cells"].get(field, [None, None, "empty", False])) for sheet, rows in s["sheets"].items() for pos, row in enumerate(rows) for field in self.layout[sheet]["fields"]]


def _folded(book: Book, operations: pd.DataFrame) -> pd.DataFrame:
    """Audit entries of a run's operations, batch by batch, book being left as they leave it."""
    names = [c.split()[0] for c in AUDIT.split(", ")]
    plain = operations.sort_values(["batch_id", "seq"], kind="stable").astype(object)
    plain = plain.where(plain.notna(), None)
    for c in ("base_revision", "to_index"):  # whole numbers, though pandas has fractions where some are null
        plain[c] = pd.Series([None if x is None else int(x) for x in plain[c]], index=plain.index, dtype=object)
    out = []
    for batch, own in plain.groupby("batch_id", sort=True):
        for n, entry in enumerate(book.batch(own.to_dict("records"))):
            out.append({"run_id": own["run_id"].iloc[0], "batch_id": batch, "nth": n, "revision": book.state["revision"]} | entry)
    made = pd.DataFrame(out, columns=names).astype(object)
    return made.where(made.notna(), None)


def audited(operations: DataFrame, layout: dict[str, dict]) -> DataFrame:
    """The audit (AUDIT) of all operations (OPERATIONS), of a table or a stream.

    The operations of a (run, batch) are one atomic batch, by seq; batches go by batch_id. `open` begins a document from the JSON in value (see `opened`), `restart` does
    so again at the next revision, with the old document in old_value; `confirm` confirms it, and an edit after that reopens it. A batch made against another
    revision (null: any) is a `conflict`; one that holds an impossible operation is `rejected` whole; neither changes the
    document. A batch that changes something raises the revision by one, one that changes nothing leaves no entry.

    A run's state is its document, as JSON; on a table the operations of a run meet in one task, since each depends on what was before.
    """
    importable(operations.sparkSession)
    if not operations.isStreaming:
        return operations.groupBy("run_id").applyInPandas(lambda own: _folded(Book(layout), own), AUDIT)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(layout, json.loads(state.get[0]) if state.exists else None)
        out = _folded(book, pd.concat(list(parts)))
        state.update((json.dumps(book.state),))
        yield out

    return operations.groupBy("run_id").applyInPandasWithState(step, AUDIT, "document string", "append", GroupStateTimeout.NoTimeout)


def documents(operations: DataFrame, layout: dict[str, dict]) -> DataFrame:
    """The cells (CELLS) of every run's document after all operations of a table."""
    importable(operations.sparkSession)
    names = [c.split()[0] for c in CELLS.split(", ")]

    def last(own: pd.DataFrame) -> pd.DataFrame:
        book = Book(layout)
        _folded(book, own)
        return pd.DataFrame([(own["run_id"].iloc[0], *c) for c in book.cells()], columns=names)

    return operations.groupBy("run_id").applyInPandas(last, CELLS)


def opened(cells: DataFrame, batch_id: int = -1, op: str = "open") -> DataFrame:
    """The operation by which each run's document begins (or restarts) from cells: run_id, sheet, pos, field, value, code."""
    base = F.to_json(F.array_sort(F.collect_list(F.struct("sheet", "pos", "field", "value", "code"))))
    rows = cells.groupBy("run_id").agg(base.alias("value"))
    kinds = dict(c.split() for c in OPERATIONS.split(", "))
    known = {"run_id": F.col("run_id"), "batch_id": F.lit(batch_id), "seq": F.lit(0), "op": F.lit(op), "value": F.col("value")}
    return rows.select(*(known.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))
