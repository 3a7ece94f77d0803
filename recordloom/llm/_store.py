"""Tables that cut lineage, in the folder that driver and executors share."""

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_LOCAL: list[str] = []


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where its folder is not yet on their path."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.startswith(("local-cluster", "spark:", "yarn", "k8s:")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="recordloom-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/recordloom/{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries started inside leave no shuffle files; the session's own setting returns afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lost executors cost no recomputation.

    What was shuffled for it goes when it is written; else it stays until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    with _tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing will read again."""
    for df in tables:
        path = df.__dict__.pop("_saved_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few numbers that may be sent to every executor: some 30 MB.
FEW = 500_000


def small(df: DataFrame, most: int | None = None, few: int = FEW) -> DataFrame:
    """df, marked to be sent to every executor if it is known to have few rows.

    `most` is a bound that the caller knows; without one, the rows of the saved table df are counted. Larger
    tables are joined by a shuffle, with the same rows.
    """
    return F.broadcast(df) if (df.count() if most is None else most) <= few else df
