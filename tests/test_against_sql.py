"""Queries against their SQL on small tables that hold what only larger ones have."""

import duckdb
import pandas as pd

from recordloom.plans import QUERIES, SQL


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the given tables."""
    db = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(folder / f"{t}.parquet", index=False)
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder / t}.parquet')")
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


def test_numbers_above_99_below_a_chapter(spark, tmp_path):
    lines = ["20.118.157.107 Betz das mit", "20.18.57.7 Betz das mit er", "31.2 Not a chapter of ours", "7.1 Ends with a return mark\r", "7.2 Has\ra return mark", "7.3 Sentence, with,\r"]
    docs = pd.DataFrame([(i, line if len(line) % 5 > 1 else f"{line}xy") for i, line in enumerate(lines)], columns=["doc_id", "text"])
    got, want = both(spark, tmp_path, "d8_numbered_candidates", documents=docs)
    assert got == want and "20.118.157.107" in {r[4] for r in got} and len(got) >= 4


def test_users_without_a_failed_call(spark, tmp_path):
    rows = [(1, 8, "a"), (1, 9, "b"), (2, 14, "b"), (2, 21, "a"), (2, 2, "a"), (3, 28, None), (4, 5, None), (6, 35, None), (6, 42, "c"), (6, 49, "a"), (None, 7, "c"), (None, 1, "c"), (5, None, "c")]
    events = pd.DataFrame(rows, columns=["user_id", "event_id", "event_type"]).astype({"user_id": "Int64", "event_id": "Int64"})
    got, want = both(spark, tmp_path, "o2_extraction_summary", events=events)
    assert got == want and (1, 2, 1, None) in got
