"""Phrases linked to the entities that they name, and activities to the concepts that they measure."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import token_set_ratio
from ..session import importable, saved

# The least score of a link, its lead over the runner-up, the least score of an assessment, and words that say nothing.
LEAST, MARGIN, LEAST_CONCEPT = 70.0, 5.0, 90.0
STOPWORDS = ["a", "an", "the", "of", "in", "and", "or", "for", "to", "with", "on", "by", "at"]


def words(text: Column) -> Column:
    """The distinct words of letters a-z and digits, but STOPWORDS."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(STOPWORDS)))


def _plain(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def scored(phrases: DataFrame, phrase: str, texts: DataFrame, scope: list[str]) -> DataFrame:
    """*scope, phrase, entity and score (0 to 100, the best over an entity's texts) of phrases and the entities that they may name.

    texts: *scope, entity, text, one row per text. A phrase whose words all stand in a text, or the other way round, scores 100, less the fewer of the
    shorter side's do; else the similarity of word sets counts. Both are looked up in an index of words and of what longer words
    begin with (three letters), so that a phrase meets only texts that share one of these; those that don't are not scored. Each
    phrase and text is compared once a scope, whatever the number of its rows.
    """
    importable(phrases.sparkSession)

    def index(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
        own = words(F.col(text))
        keys = F.array_union(F.transform(own, lambda w: F.substring(w, 1, 3)), F.filter(F.split(_plain(F.col(text)), " "), lambda w: w.rlike("[^a-z0-9]")))
        return rows.withColumn("_words", own).withColumn("_key", F.explode(keys)).select(*scope, *keep, "_words", "_key")

    asked = phrases.where(F.trim(phrase) != "").select(*scope, F.col(phrase).alias("phrase")).distinct()
    known = texts.select(*scope, "text").distinct()
    x, y = index(asked, "phrase", ["phrase"]), index(known, "text", ["text"]).withColumnRenamed("_words", "_others")
    met = saved(x.join(y, [*scope, "_key"]).groupBy(*scope, "phrase", "text").agg(F.first("_words").alias("_words"), F.first("_others").alias("_others")))
    fewer = F.least(F.size("_words"), F.size("_others"))
    cover = F.when(fewer > 0, 100.0 * F.size(F.array_intersect("_words", "_others")) / fewer).otherwise(0.0)
    whole = met.withColumn("_cover", cover)
    # a cover of 100 needs no ratio
    rest = whole.where("_cover < 100").withColumn("_score", F.greatest("_cover", token_set_ratio(_plain(F.col("phrase")), _plain(F.col("text")))))
    each = whole.where("_cover >= 100").withColumn("_score", F.lit(100.0)).unionByName(rest).select(*scope, "phrase", "text", "_score")
    return each.join(texts.select(*scope, "text", "entity").distinct(), [*scope, "text"]).groupBy(*scope, "phrase", "entity").agg(F.max("_score").alias("score"))


def best_two(scores: DataFrame, by: list[str]) -> DataFrame:
    """*by, entity and score of the best, and the score of the next best (0 if there is none)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "entity")
    placed = scores.withColumns({"_n": F.row_number().over(w), "runner_up": F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return placed.where("_n = 1").select(*by, "entity", "score", "runner_up")


def linked(references: DataFrame, key: list[str], study: str, kinds: str, phrase: str, extracted: str, confidence: str, entities: DataFrame, literals: str | None = None) -> DataFrame:
    """references with the name they link to: value, state, score and the new confidence.

    references: key, study, kinds (array: what they may point to), phrase, extracted (false: a reviewer's or derived value, never touched), confidence and literals (array
    of phrases that name no entity). entities: study, kind, entity (its row), name and texts (array of what describes it). state is `kept` (not
    extracted, blank, a literal, or a name as it is), `linked` (the best entity of all kinds has LEAST or more and a lead of MARGIN over
    the next row, of the same name too), `unclear` or `nothing` (no entity of these kinds). A link's confidence is its score at most.
    """
    rows = references.withColumns({"_kind": F.explode_outer(kinds), "_p": F.col(phrase)})
    names = entities.select(F.col(study), F.col("kind").alias("_kind"), F.col("name").alias("_p"), F.lit(True).alias("_named")).distinct()
    pools = entities.select(F.col(study), F.col("kind").alias("_kind"), F.lit(True).alias("_pool")).distinct()
    literal = F.array_contains(F.coalesce(F.col(literals), F.array().cast("array<string>")), F.col(phrase)) if literals else F.lit(False)
    blank = F.trim(F.coalesce(F.col(phrase), F.lit(""))) == ""
    known = rows.join(names, [study, "_kind", "_p"], "left").join(pools, [study, "_kind"], "left").groupBy(*key).agg(F.max("_named").alias("_named"), F.max("_pool").alias("_pool"))
    base = saved(references.join(known, key).withColumn("_kept", blank | literal | ~F.coalesce(F.col(extracted), F.lit(False)) | F.coalesce("_named", F.lit(False))))
    texts = entities.select(study, "kind", "entity", F.explode(F.array_compact(F.array_union(F.array("name"), F.coalesce("texts", F.array().cast("array<string>"))))).alias("text"))
    open_ = base.where("not _kept").select(*key, study, F.explode(kinds).alias("kind"), F.col(phrase).alias("phrase"))
    # all rows with a text score alike by it, so the best two of a phrase are among the first two of each text, and of all kinds among the best two of each
    first = Window.partitionBy(study, "kind", "text").orderBy("entity")
    texts = texts.distinct().withColumn("_n", F.row_number().over(first)).where("_n <= 2").drop("_n")
    best = Window.partitionBy(study, "kind", "phrase").orderBy(F.desc("score"), "entity")
    scores = scored(open_, "phrase", texts, [study, "kind"]).withColumn("_n", F.row_number().over(best)).where("_n <= 2").drop("_n")
    both = open_.join(scores, [study, "kind", "phrase"]).groupBy(*key, "entity", "kind").agg(F.max("score").alias("score"))
    top = best_two(both.select(*key, F.struct("kind", "entity").alias("entity"), "score"), key).select(*key, "entity.kind", "entity.entity", "score", "runner_up")
    called = entities.select(study, "kind", "entity", F.col("name").alias("_name"))
    found = base.select(*dict.fromkeys([*key, study])).join(top, key).join(called, [study, "kind", "entity"])
    out = base.join(found.select(*key, "_name", "score", "runner_up"), key, "left")
    clear = (F.col("score") >= LEAST) & (F.col("score") - F.col("runner_up") >= MARGIN)
    state = F.when(F.col("_kept"), "kept").when(~F.coalesce("_pool", F.lit(False)), "nothing").when(F.coalesce(clear, F.lit(False)), "linked").otherwise("unclear")
    out = out.withColumn("state", state)
    is_link = F.col("state") == "linked"
    columns = [c for c in references.columns if c != confidence]
    return out.select(
        *columns, F.when(is_link, F.col("_name")).otherwise(F.col(phrase)).alias("value"), "state", F.when(~F.col("_kept"), F.col("score")).alias("score"),
        F.when(is_link, F.round(F.least(F.col(confidence), F.col("score") / 100), 2)).otherwise(F.col(confidence)).alias(confidence),
    )


def concept_index(concepts: DataFrame) -> DataFrame:
    """phrase (upper case) and concept of all phrases that identify one concept: its name, or else a synonym that no other bears.

    concepts: concept (its name) and synonyms (array). A name wins over other concepts' synonyms.
    """
    names = concepts.where("concept = upper(concept)").select(F.col("concept").alias("phrase"), "concept", F.lit(0).alias("_by"))
    every = concepts.select(F.upper("concept").alias("phrase"), "concept").unionByName(concepts.select(F.explode("synonyms").alias("phrase"), "concept").withColumn("phrase", F.upper("phrase"))).where("phrase is not null").distinct()
    alone = every.groupBy("phrase").agg(F.min("concept").alias("concept"), F.count("*").alias("_n")).where("_n = 1").select("phrase", "concept", F.lit(1).alias("_by"))
    return names.unionByName(alone).groupBy("phrase").agg(F.min_by("concept", "_by").alias("concept"))


def exact_concepts(phrases: DataFrame, phrase: str, concepts: DataFrame) -> DataFrame:
    """phrases with concept: the one that the phrase names, whatever its case and the blanks around it; null if none or several."""
    index = concept_index(concepts).select(F.col("phrase").alias("_key"), "concept")
    return phrases.join(index, F.upper(F.trim(F.col(phrase))) == F.col("_key"), "left").drop("_key")


def schedulable(concept: Column) -> Column:
    """Whether a concept can be collected at a visit: no trial summary parameter, not retired."""
    return ~F.endswith(F.upper(concept), F.lit("(TS)")) & ~F.contains(F.upper(concept), F.lit("[RETIRED]"))


def activity_concepts(activities: DataFrame, study: str, activity: str, label: str, measurements: DataFrame, concepts: DataFrame) -> DataFrame:
    """study, activity, concepts (comma-separated), state, missing (array), confidence and verified of the activities of a schedule.

    measurements: study, assessment (its row), name (of the assessment), nth, value, confidence and verified. An activity whose label names one assessment (LEAST_CONCEPT,
    with a lead of MARGIN) gets the concepts of its measurements, each once, commas in them as blanks; state `none` if it has
    measurements but no concept. Another whose own label is a concept gets that (`own`, confidence 0.8). The rest stays `open`. Only schedulable
    concepts count.
    """
    rows = activities.select(study, activity, F.coalesce(F.col(label), F.col(activity).cast("string")).alias("phrase"))
    texts = measurements.select(F.col(study), F.col("assessment").alias("entity"), F.col("name").alias("text")).distinct()
    top = best_two(scored(rows, "phrase", texts, [study]), [study, "phrase"]).where((F.col("score") >= LEAST_CONCEPT) & (F.col("score") - F.col("runner_up") >= MARGIN))
    top = saved(top.withColumnRenamed("entity", "assessment"))
    named = exact_concepts(measurements.where("value is not null"), "value", concepts)
    named = named.withColumn("_c", F.when(schedulable(F.col("concept")), F.replace("concept", F.lit(","), F.lit(" "))))
    firsts = named.where("_c is not null").groupBy(study, "assessment", "_c").agg(F.min("nth").alias("nth"), F.min_by("confidence", "nth").alias("confidence"), F.min_by("verified", "nth").alias("verified"))
    listed = firsts.groupBy(study, "assessment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "_c"))), lambda x: x["_c"]), ", ").alias("concepts"), F.min("confidence").alias("_least"), F.bool_and("verified").alias("verified")
    )
    lacking = named.where("_c is null").groupBy(study, "assessment").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("missing"))
    of = top.join(listed, [study, "assessment"], "left").join(lacking, [study, "assessment"], "left")
    out = exact_concepts(rows, "phrase", concepts).join(of, [study, "phrase"], "left")
    own = schedulable(F.col("concept"))
    state = F.when(F.col("concepts").isNotNull(), "assessment").when(F.col("missing").isNotNull(), "none").when(F.col("assessment").isNull() & own, "own").otherwise("open")
    out = out.withColumn("state", state)
    pick = lambda a, b, c=None: F.when(F.col("state") == "assessment", a).when(F.col("state") == "own", b).otherwise(c)
    return out.select(
        study, activity, pick(F.col("concepts"), F.replace("concept", F.lit(","), F.lit(" "))).alias("concepts"), "state", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        pick(F.round(F.least(F.col("score") / 100, "_least"), 2), F.lit(0.8)).alias("confidence"), pick(F.col("verified"), F.lit(True)).alias("verified"),
    )
