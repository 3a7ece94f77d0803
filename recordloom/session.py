"""What jobs share: tables that cut lineage, counted broadcasts, and workers that can import this package."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL: list[str] = []
#: Rows of a few numbers that may be sent to every executor: some 30 MB.
FEW = 500_000


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where its folder is not yet on their path."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; a local one only where that is unset and driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="recordloom-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/recordloom/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_folder(spark)
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


def small(df: DataFrame, most: int | None = None, few: int = FEW) -> DataFrame:
    """df, marked to be sent to every executor if it is known to have few rows.

    `most` is a bound that the caller knows; without one, the rows of the saved table df are counted. Larger
    tables are joined by a shuffle, with the same rows.
    """
    return F.broadcast(df) if (df.count() if most is None else most) <= few else df


#: Rows that one row becomes at a time.
REPEATS = 10_000


def repeated(df: DataFrame, n: str) -> DataFrame:
    """df without n, each row n times; pieces of REPEATS are dealt out, so that a row repeated often is not one task."""
    pieces = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.expr(f"({n} - 1) div {REPEATS}")))).where(f"{n} > 0")
    pieces = pieces.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    rows = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.expr(f"cast(least({REPEATS}, {n} - _i * {REPEATS}) as int)"))))
    return rows.drop("_i", n)
