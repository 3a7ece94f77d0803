"""Input tables and the line and word tables derived from them."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """doc_id, idx, page and text of every line; pages are cut every so many lines."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return each.withColumn("page", F.floor(F.col("idx") / per_page).cast("long"))


def safe_file_name(raw, suffix: str = ".pdf", otherwise: str = "protocol", most: int = 150):
    """The last part of a path with unsafe characters as _, white space folded, at most so many characters before the suffix."""
    name = F.element_at(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, rf"(?i)\Q{suffix}\E$", ""), r"[^A-Za-z0-9 ._()\-]+", "_")
    stem = F.substring(F.regexp_replace(F.regexp_replace(stem, r"\s+", " "), "^[ ._]+|[ ._]+$", ""), 1, most)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit(otherwise)), F.lit(suffix))


def _numbered(table: pa.Table) -> pa.Table:
    """Names in order of arrival, each with the first number from 2 that gives a name not taken yet."""
    table = table.sort_by("_nth")
    taken, following, out = set(), {}, []
    for stem in table["_stem"].to_pylist():
        name, n = stem, following.get(stem, 2)
        while name in taken:
            name, n = f"{stem} ({n})", n + 1
        following[stem] = n
        taken.add(name)
        out.append(name)
    return table.select(["_within", "_stem", "_nth"]).append_column("_stored", pa.array(out, pa.string()))


def unique_names(files: DataFrame, within: str, name: str, order: str, suffix: str = "") -> DataFrame:
    """files with stored: its name, or, where an earlier file of its group has that, the name with the first ` (n)`, from 2, that is free.

    Names differ in earlier or later numbers only within a family (the name without its numbers), so a group is not one task. The families
    in which nobody bears a number himself are ranked; in the others a thin row per file goes through one pass in order.
    """
    importable(files.sparkSession)
    stem = F.regexp_replace(F.col(name), rf"(?i)\Q{suffix}\E$", "") if suffix else F.col(name)
    named = files.withColumn("_stem", stem).withColumn("_family", F.regexp_replace("_stem", r"( \([0-9]+\))+$", ""))
    odd = named.where("_stem <> _family").select(F.col(within).alias("_w"), F.col("_family").alias("_f")).distinct()
    same = F.col(within).eqNullSafe(F.col("_w")) & (F.col("_family") == F.col("_f"))
    n = F.row_number().over(Window.partitionBy(within, "_stem").orderBy(order))
    tail = F.lit(suffix)
    plain = named.join(odd, same, "left_anti").withColumn("stored", F.concat("_stem", F.when(n > 1, F.concat(F.lit(" ("), n, F.lit(")"))).otherwise(""), tail))
    rest = named.join(odd, same, "left_semi")
    thin = rest.select(F.col(within).alias("_within"), "_family", "_stem", F.col(order).alias("_nth"))
    schema = thin.select("_within", "_stem", "_nth").schema.add("_stored", "string")
    found = thin.groupBy("_within", "_family").applyInArrow(_numbered, schema)
    on = rest[within].eqNullSafe(found["_within"]) & (rest["_stem"] == found["_stem"]) & (rest[order] == found["_nth"])
    counted = rest.join(found, on).select(*(rest[c] for c in files.columns), F.concat("_stored", tail).alias("stored"))
    return plain.select(*files.columns, "stored").unionByName(counted)


def unique_uploads(files: DataFrame, within: str, name: str, content: str, order: str, suffix: str = "") -> DataFrame:
    """First upload of each content in its group, under a name that no other has; order tells the uploads of a group apart."""
    hashed = files.withColumn("sha", F.sha2(F.coalesce(content, F.lit("")), 256))
    first = hashed.groupBy(within, "sha").agg(F.min_by(F.struct(F.col(name).alias("name"), F.col(order).alias("at")), order).alias("_x"), F.count("*").alias("copies"))
    rows = first.select(within, "sha", F.col("_x.name").alias(name), F.col("_x.at").alias(order), "copies")
    return unique_names(rows, within, name, order, suffix)
