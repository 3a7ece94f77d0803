"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import decontaminate, line_dedup, near_dedup, packing, site_quality
from recordloom.llm._store import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Steps that SQL cannot express (a fitted classifier, character MinHash, BPE): tests use plain Python.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars of the text as it now is."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return site_quality.judged(docs, labels).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur, nearly the same, before; a text that had words and has none left goes."""
    left = line_dedup.deduplicated(docs.withColumn("_had", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))), "text", "doc_id")
    return _counted(left.where(~F.col("_had") | F.col("text").rlike(r"\S")), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    gone = near_dedup.near_duplicates(docs, "text", "doc_id").where("not kept").select("doc_id")
    return docs.join(saved(gone), "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a text that is mostly benchmark goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    others = [c for c in docs.columns if c != "text"]
    return _counted(decontaminate.cleaned(docs, "text", others, items, "item_id", "text"), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text in a sequence of at most 2048 tokens."""
    return packing.packed(docs, "text", "doc_id", public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
