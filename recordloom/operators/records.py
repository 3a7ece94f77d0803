"""Terminology, links, integrity, review folds, reshaping and tallies over record tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded


def exact_terms(phrases: DataFrame, phrase: str, terms: DataFrame, texts: list[str], code: str) -> DataFrame:
    """The first term whose text equals a phrase, by the order of the text columns, then code; null if none.

    Phrases are made distinct first, so that popular ones cost one lookup.
    """
    each = [terms.select(folded(F.col(c)).alias("key"), F.lit(i).alias("priority"), F.col(code).alias("code"), F.lit(c).alias("matched_on")) for i, c in enumerate(texts)]
    keys = each[0]
    for e in each[1:]:
        keys = keys.union(e)
    best = keys.groupBy("key").agg(F.min(F.struct("priority", "code", "matched_on")).alias("b"))
    distinct = phrases.select(phrase).distinct()
    return distinct.join(best, folded(F.col(phrase)) == F.col("key"), "left").select(phrase, "b.code", "b.matched_on")


def unique_keys(names: DataFrame, key: str, concept: str) -> DataFrame:
    """Keys that identify exactly one concept."""
    return names.groupBy(key).agg(F.countDistinct(concept).alias("n"), F.min(concept).alias(concept)).where("n = 1").drop("n")


def duplicates(entities: DataFrame, by: list[str], location: str) -> DataFrame:
    """Names that occur twice or more, with all their locations."""
    return entities.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(location).cast("string"))), ",").alias("locations")).where("n > 1")


def dangling(references: DataFrame, target: str, entities: DataFrame, name: str) -> DataFrame:
    """References without an entity of that exact name, with one that differs in case only as a hint."""
    missing = references.join(entities.select(F.col(name).alias(target)).distinct(), target, "left_anti")
    near = entities.groupBy(F.lower(name).alias("_low")).agg(F.min(name).alias("hint"))
    return missing.join(near, F.lower(target) == F.col("_low"), "left").drop("_low")


def sequence_names(rows: DataFrame, within: list[str], order: list[str], prefix: Column, out: str = "name") -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn(out, F.concat(prefix, F.when(n < 10, F.lit("0")).otherwise(F.lit("")), n))


def two_level(rows: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Parent columns stay on each parent's first child row only."""
    w = Window.partitionBy(*parent).orderBy(*order)
    nth = F.row_number().over(w)
    return rows.withColumn("_n", nth).select(*(F.when(F.col("_n") == 1, F.col(c)).alias(f"shown_{c}") for c in parent), *rows.columns)


def current_values(ops: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each cell, and how many changes it saw (settings to the value it had are none)."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = ops.withColumn("_old", F.lag(value).over(w)).withColumn("_c", F.when(~F.col(value).eqNullSafe(F.col("_old")), 1).otherwise(0))
    return changed.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("current"), F.sum("_c").alias("revisions"))


def audit(ops: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Operations that changed a cell, with its old value."""
    w = Window.partitionBy(*key).orderBy(*order)
    return ops.withColumn("old_value", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("old_value")))


def tallied(pairs: DataFrame, levels: list[list[str]]) -> DataFrame:
    """gold, generated, matched and their ratios by several groupings in one pass (grouping sets)."""
    columns = list(dict.fromkeys(c for level in levels for c in level))
    grouped = pairs.groupingSets([[F.col(c) for c in level] for level in levels], *(F.col(c) for c in columns))
    out = grouped.agg(*(F.sum(c).alias(c) for c in ("gold", "generated", "matched")))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 4)
    return out.withColumn("precision", ratio(F.col("matched"), F.col("generated"))).withColumn("recall", ratio(F.col("matched"), F.col("gold")))
