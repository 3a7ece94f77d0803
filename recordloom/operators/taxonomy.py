"""Sections of documents assigned to the entries of a template, from the top of each document's tree down.

A template has one row per entry: number, title and aliases (array). Its order is that of `nth`.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio
from ..functions.values import title_words, without_appendix
from ..session import importable, saved, small

# Scores from which a title counts, counts across chapters, is the same in a native document, and makes one native; what a place below
# the parent's entry adds; what is inherited; confidence of appendices, title pages and schedules; how many entries are ranked again.
LEAST, ACROSS, SAME_TITLE, SAME_NATIVE, NATIVE = 0.55, 0.75, 0.6, 0.8, 0.6
UNDER_PARENT, SAME_CHAPTER, FROM = 0.08, 0.03, 0.4
INHERITED, APPENDIX, TITLE_PAGE, SCHEDULE, REVIEW = 0.75, 0.72, 0.95, 0.85, 0.7
RANKED = 25
SCHEDULES = r"(?i)schedule of (activities|events|assessments)|time and events|flow ?chart"


def variants(template: DataFrame) -> DataFrame:
    """number, nth, at (0: the title), text and words of each entry's title and aliases."""
    texts = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = template.select("number", "nth", F.posexplode(texts).alias("at", "text"))
    return each.withColumn("words", title_words(F.col("text")))


def word_weights(words: DataFrame) -> tuple[DataFrame, float]:
    """word and weight (ln((n + 1) / (df + 1)) + 1 over all n rows of `words`, repeated ones too), and the weight of other words."""
    each = words.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where("word <> ''")
    n = words.count()
    weighted = each.groupBy("word").agg((F.log((F.lit(n) + 1.0) / (F.count("*") + 1)) + 1).alias("weight"))
    return saved(weighted), math.log(n + 1) + 1


def title_scores(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """words (of a title), number, nth, at, text and score of the titles and variants with a word in common.

    The score is twice the weight of what is shared over all weight, both sides' words counted, rounded to three places; equal titles score 1. Words are
    the same if equal, or both of six letters or more with the same four first and a ratio of 90. Distinct titles meet
    distinct variants by shared words; spellings are compared once for the whole vocabulary.
    """
    importable(titles.sparkSession)
    weights, unknown = word_weights(entries)
    own = saved(titles.select("words").where("words <> ''").distinct())
    split = lambda rows, keys: rows.select(*keys, F.explode(F.array_distinct(F.split("words", " "))).alias("word")).where("word <> ''")
    weigh = lambda rows: rows.join(small(weights), "word", "left").withColumn("weight", F.coalesce("weight", F.lit(unknown)))
    x = weigh(split(own, ["words"]))
    y = weigh(split(entries.where("words <> ''").select(F.col("words")).distinct(), [F.col("words").alias("variant")]))
    left, right = x.select("word").distinct(), y.select(F.col("word").alias("other")).distinct()
    long = lambda c: (F.char_length(c) >= 6)
    near = left.where(long("word")).join(right.where(long("other")), F.substring("word", 1, 4) == F.substring("other", 1, 4)).where("word <> other")
    near = near.where(ratio("word", "other") >= 90).select("word", "other")
    pairs = saved(left.join(right, left["word"] == right["other"]).select("word", "other").union(near))
    met = x.join(small(pairs), "word").join(y.select("variant", F.col("word").alias("other"), F.col("weight").alias("_w")), "other")
    shared = met.groupBy("words", "variant").agg(F.collect_set(F.struct("word", "weight")).alias("_x"), F.collect_set(F.struct("other", "_w")).alias("_y"))
    total = lambda c, w: F.aggregate(F.array_sort(c), F.lit(0.0), lambda s, e: s + e[w])
    one = x.groupBy("words").agg(F.sum("weight").alias("_a"))
    two = y.groupBy("variant").agg(F.sum("weight").alias("_b"))
    scored = shared.join(one, "words").join(small(two, two.count()), "variant")
    score = F.when(F.col("words") == F.col("variant"), 1.0).otherwise(F.bround((total("_x", "weight") + total("_y", "_w")) / (F.col("_a") + F.col("_b")), 3))
    return scored.select("words", "variant", score.alias("score")).join(entries.withColumnRenamed("words", "variant"), "variant").drop("variant")


def _under(number: Column, ancestor: Column) -> Column:
    return (number == ancestor) | number.startswith(F.concat(ancestor, F.lit(".")))


def _chapter(number: Column) -> Column:
    return F.split_part(number, F.lit("."), F.lit(1))


def assigned(sections: DataFrame, template: DataFrame, doc: str, review: float = REVIEW) -> DataFrame:
    """doc, section_id, node, confidence, method, matched, candidates (the best three: number, score) and needs_review of every section.

    sections: doc, section_id, number, title, level, kind (body, appendix, front, toc, title_page), parent_id and soa (holds a schedule table). In turn: contents are
    excluded; the title page is entry 0; in a native document (60 % of its numbered chapters have the entry's number and title) the number with a title of SAME_TITLE or
    more; schedules are entry 1.3; a title or alias of LEAST or more, unless a confident parent is in another chapter and it is below ACROSS; top-level appendices are 12.X; else the parent's entry
    at INHERITED of its confidence; else nothing. The RANKED best entries get a bonus where they are under the parent's entry or in its chapter;
    ties go to the higher level, then the template's order.

    Every level of the trees is one step for all documents, which joins children to what their parents became.
    """
    importable(sections.sparkSession)
    template = saved(template.select("number", "title", "aliases", "nth"))
    entries = saved(variants(template))
    rows = sections.withColumns({"_clean": title_words(without_appendix(F.col("title"))), "_plain": title_words(F.col("title"))})
    rows = saved(rows.select(doc, "section_id", "number", "title", "level", "kind", "parent_id", F.coalesce("soa", F.lit(False)).alias("soa"), "_clean", "_plain"))
    titles = rows.select(F.explode(F.array("_clean", "_plain")).alias("words"))
    scores = saved(title_scores(titles, entries))
    # the best variant of each entry; of equal ones the first
    best = scores.groupBy("words", "number", "nth").agg(F.max(F.struct("score", (-F.col("at")).alias("_at"), "text")).alias("_b"))
    best = best.select("words", "number", "nth", "_b.score", F.col("_b.text").alias("text"), (F.col("_b._at") < 0).alias("alias"))
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy("words").orderBy(F.desc("score"), "nth"))).where(F.col("_n") <= RANKED)
    # the few best entries of a title, as one row
    lists = saved(ranked.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("nth", "number", "score", "text", "alias"))).alias("_ranked")))
    by_number = saved(scores.where("at = 0").groupBy("words", "number").agg(F.max("score").alias("_same"), F.max("text").alias("_same_text")))
    top = rows.where("kind = 'body' and level = 1 and number is not null").join(by_number.select(F.col("words").alias("_plain"), "number", "_same"), ["_plain", "number"], "left")
    native = top.groupBy(doc).agg(F.avg((F.coalesce("_same", F.lit(0.0)) >= SAME_NATIVE).cast("int")).alias("_share")).select(doc, (F.col("_share") >= NATIVE).alias("_native"))
    base = rows.join(lists.withColumnRenamed("words", "_clean"), "_clean", "left").join(by_number.withColumnRenamed("words", "_plain"), ["_plain", "number"], "left").join(native, doc, "left")
    base = saved(base.withColumn("_native", F.coalesce("_native", F.lit(False))))
    # titles that share no word with the template: what then comes first
    first = template.orderBy("nth").limit(RANKED).select("number", F.size(F.split("number", r"\.")).alias("l"), "nth").orderBy("l", "nth").first()
    nobody = first["number"] if first else None
    ids = base.select(F.col(doc).alias("_d"), F.col("section_id").alias("parent_id"))
    orphan = base.join(ids, [base[doc] == ids["_d"], base["parent_id"] == ids["parent_id"]], "left_anti")
    step = saved(_decided(orphan.withColumns({"_p": F.lit(None).cast("string"), "_pc": F.lit(None).cast("double")}), doc, nobody, review))
    out = step
    while not step.isEmpty():
        above = step.select(doc, F.col("section_id").alias("parent_id"), F.col("node").alias("_p"), F.col("confidence").alias("_pc"))
        step = saved(_decided(base.join(above, [doc, "parent_id"]), doc, nobody, review))
        out = out.unionByName(step)
    return out


def _decided(rows: DataFrame, doc: str, nobody: str | None, review: float) -> DataFrame:
    """What sections become whose parents' entry (_p) and confidence (_pc) are known."""
    parent = F.when(F.col("_pc") >= 0.5, F.col("_p"))
    inside = F.when(parent != "0", parent)
    level = lambda number: F.size(F.split(number, r"\."))

    def adjusted(x: Column) -> Column:
        bonus = F.when(_under(x["number"], inside), UNDER_PARENT).when(_chapter(x["number"]) == _chapter(inside), SAME_CHAPTER).otherwise(0.0)
        score = x["score"] + F.when(x["score"] >= FROM, F.coalesce(bonus, F.lit(0.0))).otherwise(0.0)
        return F.struct((-F.bround(score, 6)).alias("key"), level(x["number"]).alias("level"), x["nth"].alias("nth"), x["number"].alias("number"), F.least(score, F.lit(1.0)).alias("score"), x["text"].alias("text"), x["alias"].alias("alias"))

    ordered = rows.withColumn("_order", F.array_sort(F.transform("_ranked", adjusted)))
    top = F.get("_order", F.lit(0))
    ordered = ordered.withColumns({"_b": F.coalesce(top["number"], F.lit(nobody)), "_s": F.coalesce(top["score"], F.lit(0.0)), "_t": top["text"], "_alias": F.coalesce(top["alias"], F.lit(False))})
    ordered = ordered.withColumn("_s", F.when(F.col("_pc").isNotNull() & (parent == F.col("_b")), F.greatest("_s", F.col("_pc") * INHERITED)).otherwise(F.col("_s")))
    jumps = F.coalesce((F.col("_pc") >= 0.8) & (_chapter(inside) != _chapter(F.col("_b"))) & (F.col("_s") < ACROSS), F.lit(False))
    schedule = F.col("title").rlike(SCHEDULES) | (F.col("soa") & (F.col("_s") < 0.8))
    answer = lambda node, confidence, method, text: F.struct(node.alias("node"), F.bround(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)), 3).alias("confidence"), method.alias("method"), text.alias("matched"))
    none, word = F.lit(None).cast("string"), F.lit
    told = (
        F.when(F.col("kind") == "toc", answer(none, F.lit(1.0), word("excluded"), none))
        .when(F.col("kind") == "title_page", answer(word("0"), F.lit(TITLE_PAGE), word("structural"), word("Title Page")))
        .when(F.col("_native") & (F.col("_same") >= SAME_TITLE), answer(F.col("number"), 0.5 + 0.5 * F.col("_same"), word("number_and_title"), F.col("_same_text")))
        .when(F.coalesce(schedule, F.lit(False)), answer(word("1.3"), F.greatest(F.when(F.col("_b") == "1.3", F.col("_s")).otherwise(0.0), F.lit(SCHEDULE)), F.when(F.col("soa"), "content_soa").otherwise("alias_match"), F.col("title")))
        .when((F.col("_s") >= LEAST) & ~jumps, answer(F.col("_b"), F.col("_s"), F.when(F.col("_alias"), "alias_match").otherwise("title_match"), F.col("_t")))
        .when((F.col("kind") == "appendix") & (F.col("level") == 1), answer(word("12.X"), F.lit(APPENDIX), word("appendix_default"), none))
        .when(parent.isNotNull(), answer(parent, F.col("_pc") * INHERITED, word("inherited"), none))
        .otherwise(answer(none, F.col("_s"), word("unmapped"), none))
    )
    fixed = F.col("kind").isin("toc", "title_page")
    shown = F.when(fixed, F.array()).otherwise(F.transform(F.slice(F.coalesce("_order", F.array()), 1, 3), lambda x: F.struct(x["number"].alias("number"), F.bround(x["score"], 3).alias("score"))))
    out = ordered.withColumn("_a", told).select(doc, "section_id", "_a.*", shown.cast("array<struct<number:string,score:double>>").alias("candidates"))
    return out.withColumn("needs_review", (F.col("method") != "excluded") & (F.col("confidence") < review))


def topic_sections(topics: DataFrame, assignments: DataFrame, sections: DataFrame, doc: str, order: str, inherited: bool = True) -> DataFrame:
    """topic, doc, section_id, order and fallback of the sections that a topic is about, for every document.

    topics: topic, numbers (entries with all that is below them), exact (entries alone), otherwise (entries for documents where those find nothing) and
    extra (section ids that always belong). Sections meet topics by their entry and the entries above it, so a topic is joined, not tried.
    """
    have = assignments.where("node is not null and method <> 'excluded'" + ("" if inherited else " and method <> 'inherited'")).select(doc, "section_id", "node")
    parts = F.split("node", r"\.")
    above = have.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    wanted = lambda c: topics.select("topic", F.explode(c).alias("_up"))
    own = above.join(wanted("numbers"), "_up").select("topic", doc, "section_id")
    exact = have.join(wanted("exact").withColumnRenamed("_up", "node"), "node").select("topic", doc, "section_id")
    found = saved(own.union(exact).distinct().withColumn("fallback", F.lit(False)))
    instead = above.join(wanted("otherwise"), "_up").select("topic", doc, "section_id").distinct()
    instead = instead.join(found.select("topic", doc).distinct(), ["topic", doc], "left_anti").withColumn("fallback", F.lit(True))
    extra = topics.select("topic", F.explode("extra").alias("section_id")).join(sections.select(doc, "section_id"), "section_id").select("topic", doc, "section_id").withColumn("fallback", F.lit(False))
    every = found.unionByName(instead).unionByName(extra).groupBy("topic", doc, "section_id").agg(F.max("fallback").alias("fallback"))
    return every.join(sections.select(doc, "section_id", order), [doc, "section_id"]).select("topic", doc, "section_id", order, "fallback")
