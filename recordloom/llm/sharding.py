"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranks import ranked
from ._store import saved


def interleave(df: DataFrame, source: str, row_id: str, shards: int, seed: int = 17) -> DataFrame:
    """Adds shard (0 to shards-1) and slot (gapless from 0 within its shard).

    Rows are shuffled within their source by a seeded hash, ranked, and sorted by fractional rank
    (2*rank+1)/(2*size of source); contiguous cuts of that order give shards whose row counts are at
    most one apart and whose shares of each source are those of the table.

    Null sources form one stratum, repeated and null ids are rows like any other, an empty table gives
    no rows. Columns of df named _key, _rank, _size, _source, _frac, _pos are not allowed; all others stay.
    """
    keyed = df.withColumn("_key", F.xxhash64(F.lit(seed), F.col(row_id)))
    inner = ranked(keyed, ["_key", row_id], [source], "_rank")
    inner = saved(inner)
    sizes = inner.groupBy(source).agg((F.max("_rank") + 1).alias("_size")).withColumnRenamed(source, "_source")
    frac = (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_size"))
    spread = inner.join(saved(sizes), inner[source].eqNullSafe(F.col("_source"))).withColumn("_frac", frac).drop("_source", "_size", "_rank")
    placed = ranked(spread, ["_frac", "_key", row_id], name="_pos")
    total = max(inner.count(), 1)
    return (
        placed.withColumn("shard", F.expr(f"cast(_pos * {shards} div {total} as int)"))
        .withColumn("slot", F.expr(f"_pos - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))
        .drop("_key", "_frac", "_pos")
    )


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(rows, "source", "doc_id", 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )

