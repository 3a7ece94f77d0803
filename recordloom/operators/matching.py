"""Generated records against gold ones: similar pairs, one-to-one alignment, tallies; titles against a taxonomy."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio, token_set_ratio, token_sort_ratio
from ..functions.text import folded
from ..functions.values import normal_text, normal_value
from ..session import importable, saved


def text_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `similarity` (how closely two texts agree) and `affinity` (how likely they mean the same), 0 to 1.

    Texts that are equal when normalised need no ratio; the others are scored once for each distinct pair.
    Containment counts nine tenths for affinity; texts whose numbers have nothing in common lose half of it. Words
    are runs of letters and digits of any script; texts of marks alone agree with each other. A null text is an empty one.
    """
    importable(pairs.sparkSession)
    either = {f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in (a, b)}
    distinct = pairs.select(*(x.alias(c) for c, x in either.items())).distinct().withColumns({"_x": normal_text(F.col(f"_{a}")), "_y": normal_text(F.col(f"_{b}"))})
    same = (F.col("_x") == F.col("_y")) | ((F.col("_x") != "") & (normal_value(F.col(f"_{a}")) == normal_value(F.col(f"_{b}"))))
    scored = distinct.withColumn("_same", same)
    words = [F.trim(F.regexp_replace(F.col(c), r"(?U)[^\w]+", " ")) for c in ("_x", "_y")]
    ratios = scored.where("not _same and _x <> '' and _y <> ''").withColumns({"_u": words[0], "_v": words[1]})
    sort = F.when((F.col("_u") != "") | (F.col("_v") != ""), token_sort_ratio("_u", "_v")).otherwise(0.0)
    left = ratios.select(f"_{a}", f"_{b}", F.greatest(ratio("_x", "_y"), sort).alias("_r"), token_set_ratio("_u", "_v").alias("_s"))
    numbers = [F.regexp_extract_all(F.col(c), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)) for c in ("_x", "_y")]
    clash = (F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0) & ~F.arrays_overlap(*numbers)
    both = scored.join(left, [f"_{a}", f"_{b}"], "left").withColumn("similarity", F.when(F.col("_same"), 1.0).otherwise(F.coalesce(F.col("_r") / 100, F.lit(0.0))))
    whole = F.greatest("similarity", F.when(F.col("_same"), 0.9).otherwise(0.9 * F.coalesce(F.col("_s") / 100, F.lit(0.0))))
    affinity = F.when((F.col("_x") == "") | (F.col("_y") == ""), 0.0).otherwise(whole * F.when(clash, 0.5).otherwise(1.0))
    out = both.select(f"_{a}", f"_{b}", "similarity", affinity.alias("affinity"))
    return pairs.withColumns(either).join(out, [f"_{a}", f"_{b}"]).drop(f"_{a}", f"_{b}")


def row_pairs(gold: DataFrame, made: DataFrame, unit: list[str], pos: str, columns: list[str], floor: float = 0.45) -> DataFrame:
    """unit, i, j and score of the pairs of a gold and a generated row of one unit that score `floor` or more.

    The score is 0.85 of the mean agreement of the columns filled on both sides, and 0.15 of how near the two
    rows' relative places are. unit should hold the columns of a scope too, so that only rows of equal scope meet.
    """

    def side(rows: DataFrame, row: str, mark: str) -> DataFrame:
        last = rows.groupBy(*unit).agg(F.greatest(F.max(pos), F.lit(1)).alias(f"_last_{mark}"))
        return rows.select(*unit, F.col(pos).alias(row), *(normal_value(F.col(c).cast("string")).alias(f"{mark}_{c}") for c in columns)).join(last, unit)

    both = side(gold, "i", "g").join(side(made, "j", "m"), unit)
    filled = [(F.coalesce(F.col(f"g_{c}"), F.lit("")) != "") & (F.coalesce(F.col(f"m_{c}"), F.lit("")) != "") for c in columns]
    agree = sum((F.when(f & (F.col(f"g_{c}") == F.col(f"m_{c}")), 1).otherwise(0) for f, c in zip(filled, columns, strict=True)), F.lit(0))
    seen = sum((F.when(f, 1).otherwise(0) for f in filled), F.lit(0))
    place = 1 - F.abs(F.col("i") / F.col("_last_g") - F.col("j") / F.col("_last_m"))
    score = F.round(0.85 * F.coalesce(agree / F.nullif(seen, F.lit(0)), F.lit(0.0)) + 0.15 * place, 6)
    return both.select(*unit, "i", "j", score.alias("score")).where(F.col("score") >= floor)


def best_pairs(pairs: DataFrame, unit: list[str]) -> DataFrame:
    """One-to-one pairs, the best score first, ties by i and j: what picking them one by one would give.

    In each round the pairs that are best for both of their rows are kept, and pairs that share a row with
    them go, until none is left. Rounds are written out below spark.checkpoint.dir.
    """
    kept, rest = None, pairs
    while True:
        order = [F.desc("score"), "i", "j"]
        nth = [F.row_number().over(Window.partitionBy(*unit, c).orderBy(*order)) for c in ("i", "j")]
        ranked = rest.withColumn("_a", nth[0]).withColumn("_b", nth[1])
        ranked = saved(ranked)
        best = ranked.where("_a = 1 and _b = 1").select(*pairs.columns)
        kept = best if kept is None else kept.union(best)
        rest = ranked.where("_a > 1 or _b > 1").select(*pairs.columns)
        rest = rest.join(best.select(*unit, "i"), [*unit, "i"], "left_anti").join(best.select(*unit, "j"), [*unit, "j"], "left_anti").select(*pairs.columns)
        if rest.isEmpty():
            return kept


def cell_tally(gold: DataFrame, made: DataFrame, pairs: DataFrame, unit: list[str], pos: str, column: str) -> DataFrame:
    """gold, generated, matched and slots of a comma-separated column per unit; unpaired rows are missing or extra.

    Items are compared as sets; slots are all items that any of the two sides has.
    """
    split = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: folded(x)), lambda x: x != ""))
    g = gold.select(*unit, F.col(pos).alias("i"), split(F.col(column)).alias("g"))
    m = made.select(*unit, F.col(pos).alias("j"), split(F.col(column)).alias("m"))
    both = g.join(pairs.select(*unit, "i", "j"), [*unit, "i"], "left").join(m, [*unit, "j"], "full")
    empty = F.array().cast("array<string>")
    x, y = F.coalesce("g", empty), F.coalesce("m", empty)
    matched = F.size(F.array_intersect(x, y))
    counts = both.select(*unit, F.size(x).alias("gold"), F.size(y).alias("generated"), matched.alias("matched"), F.size(F.array_union(x, y)).alias("slots"))
    return counts.groupBy(*unit).agg(*(F.sum(c).alias(c) for c in ("gold", "generated", "matched", "slots")))


def title_scores(titles: DataFrame, title: str, template: DataFrame, node: str, variant: str, weights: DataFrame, unknown: float) -> DataFrame:
    """title, node and score: the best weighted word overlap (Dice) with any variant of each template entry.

    weights: word, weight; others weigh `unknown`. Distinct titles and variants meet by the words they share.
    """

    def words(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
        each = rows.select(*keys).distinct().withColumn("word", F.explode(F.array_distinct(F.split(F.col(text), " ")))).where("word <> ''")
        return each.join(weights.select("word", F.col("weight")), "word", "left").withColumn("weight", F.coalesce("weight", F.lit(unknown)))

    a, b = words(titles, [title], title), words(template, [node, variant], variant)
    one, two = a.groupBy(title).agg(F.sum("weight").alias("_wa")), b.groupBy(node, variant).agg(F.sum("weight").alias("_wb"))
    shared = a.join(b.drop("weight"), "word").groupBy(title, node, variant).agg(F.sum("weight").alias("_w"))
    scored = shared.join(one, title).join(two, [node, variant]).withColumn("_s", F.round(2 * F.col("_w") / (F.col("_wa") + F.col("_wb")), 3))
    return scored.groupBy(title, node).agg(F.max("_s").alias("score"))


def coverage(documents: DataFrame, doc: str, template: DataFrame, node: str, assigned: DataFrame, confidence: str, section: str, enough: float = 0.7) -> DataFrame:
    """Every template node of every document: found, low_confidence or missing, with its sections."""
    grid = documents.select(doc).distinct().crossJoin(F.broadcast(template.select(node).distinct()))  # the template's few entries
    have = assigned.groupBy(doc, node).agg(F.max(confidence).alias("best"), F.array_sort(F.collect_set(section)).alias("sections"))
    state = F.when(F.col("best").isNull(), "missing").when(F.col("best") >= enough, "found").otherwise("low_confidence")
    return grid.join(have, [doc, node], "left").withColumn("state", state)


def candidates(phrases: DataFrame, scope: str, phrase: str, terms: DataFrame, code: str, texts: list[str], most: int = 5) -> DataFrame:
    """What each distinct phrase may stand for within its scope: code, score, place and status.

    texts: columns of terms with a text or an array of them. A phrase that is a code, or equals a text of a term, is `exact`, and that
    term, by the order of the columns, is all it gets. Others get the best `most` terms by their best text, `fuzzy` if the first has 80 or more, else
    `unresolved`, and are never given a code by that. A phrase whose scope has no terms keeps a row without one; null and blank phrases have no status.
    """
    importable(phrases.sparkSession)
    asked = phrases.select(scope, phrase).distinct().withColumn("_x", folded(F.col(phrase)))
    kinds = dict(terms.dtypes)
    listed = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    told = lambda by: lambda t: F.struct(F.lit(by).alias("by"), folded(t).alias("text"))
    each = F.concat(*(F.transform(F.coalesce(listed(c), F.array().cast("array<string>")), told(i)) for i, c in enumerate([code, *texts])))
    known = terms.select(scope, F.col(code).alias("_code"), F.explode(each).alias("_t")).select(scope, "_code", "_t.by", F.col("_t.text").alias("_y")).where("coalesce(_y, '') <> ''").distinct()
    exact = asked.withColumn("_y", F.col("_x")).join(known, [scope, "_y"]).groupBy(scope, phrase).agg(F.min_by("_code", F.struct("by", "_code")).alias(code))
    exact = exact.select(scope, phrase, code, F.lit(100.0).alias("score"), F.lit(1).alias("place"), F.lit("exact").alias("status"))
    left = asked.where("coalesce(_x, '') <> ''").join(exact.select(scope, phrase), [scope, phrase], "left_anti")
    pairs = left.join(known.where("by > 0").select(scope, "_code", "_y").distinct(), scope)
    # equal words, other than in order, and equal texts need no ratio; the rest is scored once for each pair of texts
    scores = saved(pairs.select("_x", "_y").distinct()).withColumn("_s", F.round(F.greatest(token_set_ratio("_x", "_y"), ratio("_x", "_y")), 1))
    best = pairs.join(scores, ["_x", "_y"]).groupBy(scope, phrase, F.col("_code").alias(code)).agg(F.max("_s").alias("score"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy(scope, phrase).orderBy(F.desc("score"), code))).where(F.col("place") <= most)
    placed = placed.withColumn("status", F.when(F.max("score").over(Window.partitionBy(scope, phrase)) >= 80, "fuzzy").otherwise("unresolved"))
    found = exact.unionByName(placed).withColumnsRenamed({scope: "_scope", phrase: "_phrase"})
    same = F.col(scope).eqNullSafe(F.col("_scope")) & F.col(phrase).eqNullSafe(F.col("_phrase"))
    out = asked.join(found, same, "left").select(scope, phrase, "_x", code, "score", "place", "status")
    return out.withColumn("status", F.when(F.coalesce("_x", F.lit("")) != "", F.coalesce("status", F.lit("unresolved")))).drop("_x")


def joined_confidence(cells: DataFrame, by: list[str], confidence: str, verified: str, judged: Column) -> DataFrame:
    """A cell made of several values: the least confidence, 0.8 at most where any was judged, verified if all are."""
    least = F.least(F.min(confidence), F.when(F.max(judged), 0.8).otherwise(1.0))
    return cells.groupBy(*by).agg(least.alias("confidence"), F.bool_and(verified).alias("verified"))
