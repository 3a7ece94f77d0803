"""Nested JSON artefacts with a fixed schema, and results kept by study and run."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import saved

_BAD = "_unreadable"


def read_artefacts(spark: SparkSession, path: str | list[str], schema: T.StructType | str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """The readable artefacts (with the columns of schema) and the others (file, content) of JSON files.

    The schema is given and never inferred; fields that it does not name are left out, and missing ones are null. An artefact that is no JSON, or of
    another shape, is set aside with its file and content and fails nothing. whole_files: one artefact a file, else one a line.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"multiLine": whole_files, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    # saved, as Spark answers nothing about unreadable records alone from the raw files
    rows = spark.read.schema(T.StructType([*kinds.fields, T.StructField(_BAD, T.StringType())])).options(**options).json(path)
    rows = saved(rows.withColumn("file", F.col("_metadata.file_path")))
    good = rows.where(F.col(_BAD).isNull()).select(*(F.col(f"`{f.name}`") for f in kinds.fields), "file")
    return good, rows.where(F.col(_BAD).isNotNull()).select("file", F.col(_BAD).alias("content"))


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("study_id", "run_id"), append: bool = False, kind: str = "parquet") -> None:
    """Results in folders by study and run; those of the runs that are written again are replaced, others stay. append: nothing is replaced, as in an audit.

    A run's rows are brought together first, so that it has few files.
    """
    rows = results.repartition(*by)
    writer = rows.write.partitionBy(*by).mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic")
    writer.format(kind).save(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """What `write_results` has written; a filter on study and run reads their folders only."""
    return spark.read.schema(schema).format(kind).load(path)
