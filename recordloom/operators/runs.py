"""Run bookkeeping: reuse of stored results, precedence, staleness, outlines, differences and totals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def input_hash(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a zero byte, so that order and borders count; null is empty."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")))), 256)


def reuse_plan(new: DataFrame, stored: DataFrame, key: str, inputs: str, post: str, status: str, usable: list[str]) -> DataFrame:
    """key and action: skip what is unchanged, reprocess where only `post` changed, run the rest.

    A stored result counts only with a usable status; stored has one row a key.
    """
    old = stored.where(F.col(status).isin(usable)).select(key, F.col(inputs).alias("_inputs"), F.col(post).alias("_post"), F.lit(True).alias("_has"))
    same = F.col("_has") & F.col(inputs).eqNullSafe(F.col("_inputs"))
    action = F.when(same & F.col(post).eqNullSafe(F.col("_post")), "skip").when(same, "reprocess").otherwise("run")
    return new.join(old, key, "left").select(key, action.alias("action"))


def precedence(current: DataFrame, stored: DataFrame, key: list[str], value: str, failed: str) -> DataFrame:
    """The current value; the stored one of keys not run now; nothing where the current run failed."""
    now = current.select(*key, F.col(value).alias("_now"), F.col(failed).alias("_failed"))
    both = now.join(stored.select(*key, F.col(value).alias("_old")), key, "full")
    out = F.when(F.col("_failed").isNull(), F.col("_old")).when(~F.col("_failed"), F.col("_now"))
    return both.select(*key, out.alias(value)).where(F.col(value).isNotNull())


def parents(rows: DataFrame, within: list[str], order: list[str], level: str, row_id: str, levels: int = 6) -> DataFrame:
    """Adds parent: the nearest earlier row of a smaller level, levels being 1 to `levels`."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    by_level = [F.when(F.col(level) == n, F.last(F.when(F.col(level) < n, F.col(row_id)), ignorenulls=True).over(w)) for n in range(2, levels + 1)]
    return rows.withColumn("parent", F.coalesce(*by_level))


def order_statistic(rows: DataFrame, within: list[str], value: str, share: float) -> DataFrame:
    """The value at place floor(share * (n - 1)) of each group's sorted values; no interpolation."""
    w = Window.partitionBy(*within)
    placed = rows.where(F.col(value).isNotNull()).select(*within, value, F.row_number().over(w.orderBy(value)).alias("_at"), F.count("*").over(w).alias("_n"))
    return placed.where(F.col("_at") == F.floor(F.lit(share) * (F.col("_n") - 1)) + 1).select(*within, value)


def design(arms: DataFrame, epochs: DataFrame, study: str, arm: str, epoch: str, treatment: str) -> DataFrame:
    """Every arm of a study with each of its epochs: treatment epochs have an element per arm, others share one."""
    element = F.when(F.col(treatment), F.concat_ws("-", F.col(arm).cast("string"), F.col(epoch).cast("string"))).otherwise(F.col(epoch).cast("string"))
    return arms.select(study, arm).distinct().join(epochs.select(study, epoch, treatment).distinct(), study).select(study, arm, epoch, element.alias("element"))


def differences(gold: DataFrame, made: DataFrame, key: list[str], value: str, unit: str, most: int = 25) -> DataFrame:
    """The first `most` cells of each unit that differ: mismatch, missing (gold only) or extra."""
    both = gold.select(*key, F.col(value).alias("gold"), F.lit(1).alias("_g")).join(made.select(*key, F.col(value).alias("made"), F.lit(1).alias("_m")), key, "full")
    kind = F.when(F.col("_m").isNull(), "missing").when(F.col("_g").isNull(), "extra").when(~F.col("gold").eqNullSafe(F.col("made")), "mismatch")
    found = both.withColumn("kind", kind).where("kind is not null")
    nth = F.row_number().over(Window.partitionBy(unit).orderBy(*(k for k in key if k != unit)))
    return found.withColumn("n", nth).where(F.col("n") <= most).select(*key, "gold", "made", "kind", "n")


def totals(issues: DataFrame, by: list[str], blocking: Column, warning: Column) -> DataFrame:
    """Blocking and warning issues per group, per leading group and in all; confirmable where none blocks."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = issues.rollup(*by).agg(count(blocking).alias("blocking"), count(warning).alias("warnings"))
    return out.withColumn("confirmable", F.col("blocking") == 0)


def inverse_frequency(titles: DataFrame, title: str) -> DataFrame:
    """word and weight: ln((n + 1) / (df + 1)) + 1 over the n distinct titles."""
    each = titles.select(title).where(F.col(title).isNotNull()).distinct()
    words = each.select(F.explode(F.array_distinct(F.split(F.lower(title), " "))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("df"))
    n = each.agg(F.count("*").alias("n"))  # one row
    return words.join(F.broadcast(n)).select("word", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("weight"))


def stale(outputs: DataFrame, inputs: DataFrame, key: list[str], checks: dict[str, str]) -> DataFrame:
    """Outputs whose stored columns differ from the input's current ones, with the reasons; checks maps column to reason."""
    now = inputs.select(*key, *(F.col(c).alias(f"_now_{c}") for c in checks))
    reasons = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_now_{c}")), F.lit(why)) for c, why in checks.items())))
    return outputs.join(now, key).withColumn("reasons", reasons).where("size(reasons) > 0").select(*key, "reasons")


def unmapped(cells: DataFrame, layout: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """How many filled cells lie outside the layout, by location."""
    return cells.join(layout.select(*on).distinct(), on, "left_anti").groupBy(*by).agg(F.count("*").alias("n"))


def run_status(stages: DataFrame, run: str, produced: Column) -> DataFrame:
    """A run awaits review if any of its stages produced something, else it failed."""
    made = stages.groupBy(run).agg(F.sum(F.when(produced, 1).otherwise(0)).alias("produced"))
    return made.withColumn("status", F.when(F.col("produced") > 0, "awaiting_review").otherwise("failed"))
