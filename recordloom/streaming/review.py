"""The revision check of review batches, as a batch and as a stream."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import importable

#: run_id, batch_id, the revision it was made against, whether all its operations are valid, how many change something.
SCHEMA = "run_id string, batch_id long, base_revision long, valid boolean, changes long"
OUT = "run_id string, batch_id long, accepted boolean, revision long"


def _step(revision: int, batch: pd.DataFrame) -> tuple[int, pd.DataFrame]:
    rows = []
    for r in batch.sort_values("batch_id").itertuples():
        accepted = bool(r.valid) and r.base_revision == revision
        revision += accepted and r.changes > 0
        rows.append((r.run_id, r.batch_id, accepted, int(revision)))
    return int(revision), pd.DataFrame(rows, columns=["run_id", "batch_id", "accepted", "revision"])


def revisions(batches: DataFrame) -> DataFrame:
    """accepted, and the revision after it, of each operation batch of each run, in order of batch_id.

    A batch made against another revision, or with one invalid operation, is rejected whole; an accepted one
    raises the revision by one if it changes anything. Works on streams, whose state is one number a run, and
    on tables, where a run's batches meet in one task: each depends on the one before.
    """
    importable(batches.sparkSession)
    if not batches.isStreaming:
        return batches.groupBy("run_id").applyInPandas(lambda own: _step(0, own)[1], OUT)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, out = _step(state.get[0] if state.exists else 0, pd.concat(list(parts)))
        state.update((revision,))
        yield out

    return batches.groupBy("run_id").applyInPandasWithState(step, OUT, "revision long", "append", GroupStateTimeout.NoTimeout)


def of_operations(operations: DataFrame) -> DataFrame:
    """The batches (as SCHEMA) of single operations with run_id, batch_id, base_revision, valid and changed."""
    return operations.groupBy("run_id", "batch_id").agg(
        F.min("base_revision").alias("base_revision"), F.bool_and("valid").alias("valid"), F.sum(F.col("changed").cast("long")).alias("changes")
    )
