"""Generated tables against gold ones: comparable keys, row similarity, alignments, learned names and cell tallies.

Cells are long: study, unit (a table of the layout), pos (the row, from 0), header and value. The layout has a row per unit and header:
tier (identifier, reference, code, value or text), multi (comma-separated), kind (the kind of entity that an identifier names or a reference
points to), literals (references that name no entity), scope (rows pair only if it agrees) and ordered (the unit is a sequence).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, items
from ..functions.values import normal_text, normal_value
from ..session import importable, saved, small
from .matching import best_pairs, text_scores

# Share of a row's place in its score, least score, and from when on texts agree.
PLACE, FLOOR, AGREE = 0.15, 0.45, 0.85


def with_layout(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """Filled cells of the layout with its columns and their items; blank cells and those outside the layout go."""
    some = F.array(F.col("value"))
    rows = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").join(small(layout, layout.count()), ["unit", "header"])
    return rows.withColumn("items", F.when(F.col("multi"), items(F.col("value"))).otherwise(some))


def with_keys(cells: DataFrame, names: DataFrame | None = None, codes: DataFrame | None = None, same: dict[str, list[str]] | None = None) -> DataFrame:
    """cells of `with_layout` with keys: what their items are compared by, each once.

    Codes are looked up by header and folded text in codes (header, text, code); others stay as normalised text, `Other = reason` as
    its reason, and a set of codes that means one code (same: code to its set) is that. References of generated cells become the gold name
    that names (study, kind, made, gold) has for them; literals stay; the others are marked unaligned. Without names references stay as they are, which is
    how gold cells are. Values are compared as normalised values, identifiers and texts as normalised text.
    """
    looked_up = F.lit(False)
    if codes is not None:
        looked_up |= F.col("tier").eqNullSafe("code")
    if names is not None:
        looked_up |= F.col("tier").eqNullSafe("reference")
    some = cells.where(F.size("items") > 0)
    own = F.transform("items", lambda x: F.when(F.col("tier") == "value", normal_value(x)).otherwise(normal_text(x)))
    keyed = some.where(~looked_up).withColumn("keys", F.array_sort(F.array_distinct(F.array_compact(own))))
    if codes is not None or names is not None:
        keyed = keyed.unionByName(_with_known_keys(some.where(looked_up), names, codes))
    for code, members in (same or {}).items():
        keyed = keyed.withColumn("keys", F.when(F.col("keys") == F.array(*map(F.lit, sorted(members))), F.array(F.lit(code))).otherwise(F.col("keys")))
    return keyed


def _with_known_keys(cells: DataFrame, names: DataFrame | None, codes: DataFrame | None) -> DataFrame:
    """cells with the keys of those that are looked up in names or codes."""
    each = cells.select("study", "unit", "header", "pos", "tier", "kind", "literals", F.posexplode("items").alias("_at", "_item")).withColumn("_norm", normal_text(F.col("_item")))
    key = F.col("_norm")
    if codes is not None:
        known = codes.select(F.col("header").alias("_h"), folded(F.col("text")).alias("_t"), F.col("code").alias("_code")).dropDuplicates(["_h", "_t"])
        each = each.join(known, (F.col("tier") == "code") & (F.col("header") == F.col("_h")) & (folded(F.col("_item")) == F.col("_t")), "left")
        reason = F.when(F.lower("_item").startswith("other") & F.contains("_item", F.lit("=")), F.concat(F.lit("other="), normal_text(F.regexp_extract("_item", "(?s)=(.*)$", 1))))
        key = F.when(F.col("tier") == "code", F.coalesce(reason, "_code", "_norm")).otherwise(key)
    if names is not None:
        learned = names.select(F.col("study").alias("_s"), F.col("kind").alias("_k"), F.col("made").alias("_m"), F.col("gold").alias("_g"))
        each = each.join(learned, (F.col("tier") == "reference") & F.col("study").eqNullSafe(F.col("_s")) & (F.col("kind") == F.col("_k")) & (F.col("_norm") == F.col("_m")), "left")
        literal = F.exists(F.coalesce("literals", F.array().cast("array<string>")), lambda x: normal_text(x) == F.col("_norm"))
        key = F.when(F.col("tier") == "reference", F.when(literal, F.col("_norm")).otherwise(F.coalesce("_g", F.concat(F.lit("unaligned:"), "_norm")))).otherwise(key)
    keyed = each.withColumn("_key", key).groupBy("study", "unit", "header", "pos").agg(F.array_sort(F.collect_set("_key")).alias("keys"))
    rows = [F.col("a.study").eqNullSafe(F.col("b.study")), *(F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("unit", "header", "pos"))]
    return cells.alias("a").join(keyed.alias("b"), rows).select("a.*", "b.keys")


def row_scores(gold: DataFrame, made: DataFrame, sizes: DataFrame, usable: Column) -> DataFrame:
    """study, unit, i, j and score (FLOOR or more) of the pairs of a gold and a generated row that may be the same entry.

    gold and made are cells of `with_keys`; sizes: study, unit, n_gold, n_made. A pair's similarity is the mean over the columns filled
    on both sides, with the name or without, whichever is better: shared keys over all keys, for texts their affinity, taken once for
    each pair of texts. `usable` says which columns but names count. Rows meet within their study, unit and scope; scope columns are
    compared whole, so that they are join keys. PLACE of the score is how near the rows' relative places are.
    """
    scope = F.array_sort(F.collect_list(F.when(F.col("scope") & usable, F.struct("header", "keys"))))

    def side(cells: DataFrame, row: str, mark: str) -> DataFrame:
        own = cells.groupBy("study", "unit", "pos").agg(scope.alias("_scope"))
        rows = cells.where(usable | (F.col("tier") == "identifier")).join(own, ["study", "unit", "pos"])
        return rows.select("study", "unit", "_scope", "header", "tier", F.col("pos").alias(row), F.col("keys").alias(f"_{mark}"), F.col("value").alias(f"{mark}_text"))

    both = side(gold, "i", "g").join(side(made, "j", "m").drop("tier"), ["study", "unit", "_scope", "header"])
    texts = saved(text_scores(both.where("tier = 'text'").select("g_text", "m_text").distinct(), "g_text", "m_text"))
    both = both.join(small(texts.drop("similarity")), ["g_text", "m_text"], "left")
    alike = F.when(F.col("tier") == "text", F.col("affinity")).otherwise(F.size(F.array_intersect("_g", "_m")) / F.size(F.array_union("_g", "_m")))
    means = both.withColumn("_s", alike).groupBy("study", "unit", "i", "j").agg(F.avg(F.when(F.col("tier") != "identifier", F.col("_s"))).alias("_content"), F.avg("_s").alias("_named"))
    place = 1 - F.abs(F.col("i") / F.greatest(F.col("n_gold") - 1, F.lit(1)) - F.col("j") / F.greatest(F.col("n_made") - 1, F.lit(1)))
    scored = means.join(small(sizes, sizes.count()), ["study", "unit"]).withColumn("score", (1 - PLACE) * F.greatest("_content", "_named") + PLACE * place)
    return scored.where(F.col("score") >= FLOOR).select("study", "unit", "i", "j", "score")


def non_crossing(i: np.ndarray, j: np.ndarray, score: np.ndarray, floor: float = FLOOR) -> list[int]:
    """Which of the pairs make up the non-crossing one-to-one alignment with the greatest sum of margins over `floor`.

    Walking back from the ends, a pair is taken where it makes up the best sum, else the gold row is left, else the generated one.
    """
    if not len(i):
        return []
    n, m = int(i.max()) + 1, int(j.max()) + 1
    at = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(i, j, strict=True))}
    rows: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), k in at.items():
        rows[a][b] = float(score[k]) - floor
    best = np.zeros((n + 1, m + 1))
    for a in range(n):
        row = best[a].copy()
        for b, gain in rows[a].items():
            row[b + 1] = max(row[b + 1], best[a, b] + gain)
        best[a + 1] = np.maximum.accumulate(row)
    kept, a, b = [], n, m
    while a and b:
        gain = rows[a - 1].get(b - 1)
        if gain is not None and best[a, b] == best[a - 1, b - 1] + gain:
            a, b = a - 1, b - 1
            kept.append(at[a, b])
        elif best[a, b] == best[a - 1, b]:
            a -= 1
        else:
            b -= 1
    return sorted(kept)


#: Cells of a unit's table up to which units are aligned side by side, and cells of all tables in memory at a time.
SMALL, CELLS = 1 << 10, 1 << 21


def non_crossing_units(first: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """Which pairs `non_crossing` keeps of each of many units, whose pairs lie one after the other; first: where each one's begin, and the end.

    Small units go through the same steps side by side. Rows without a pair are left out, which changes nothing.
    """
    kept, many = np.zeros(len(i), bool), np.diff(first)
    unit = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((i, unit))
    new = np.ones(len(order), bool)
    new[1:] = (i[order][1:] != i[order][:-1]) | (unit[order][1:] != unit[order][:-1])
    nth = np.cumsum(new)
    begins = np.concatenate(([0], nth))[first]  # a unit's pairs are together in the order too
    row = np.empty(len(i), np.int64)
    row[order] = nth - 1 - begins[unit[order]]
    n, m = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
    np.maximum.at(n, unit, row + 1)
    np.maximum.at(m, unit, j + 1)
    size = (n + 1) * (m + 1)
    for u in np.flatnonzero(size > SMALL):
        own = slice(first[u], first[u + 1])
        kept[first[u] + np.array(non_crossing(i[own], j[own], score[own], floor), np.int64)] = True
    some = np.flatnonzero((size <= SMALL) & (many > 0))
    shape = np.ceil(np.log2(n[some])) * 64 + np.ceil(np.log2(m[some]))  # within a factor of two, so that little is padded
    for alike in (some[shape == x] for x in np.unique(shape)):
        step = max(1, CELLS // int((n[alike].max() + 1) * (m[alike].max() + 1)))
        for us in (alike[at : at + step] for at in range(0, len(alike), step)):
            _align_small(us, n, m, unit, row, j, score, floor, kept)
    return kept


def _align_small(us: np.ndarray, n: np.ndarray, m: np.ndarray, unit: np.ndarray, row: np.ndarray, j: np.ndarray, score: np.ndarray, floor: float, kept: np.ndarray) -> None:
    """Marks in kept the pairs of the units us, which go through the steps of `non_crossing` side by side."""
    rows, columns = int(n[us].max()), int(m[us].max())
    local = np.full(len(n), -1)
    local[us] = np.arange(len(us))
    of = np.flatnonzero(local[unit] >= 0)
    gain, pair = np.full((len(us), rows, columns), -np.inf), np.zeros((len(us), rows, columns), np.int64)
    gain[local[unit[of]], row[of], j[of]] = score[of] - floor
    pair[local[unit[of]], row[of], j[of]] = of
    best = np.zeros((len(us), rows + 1, columns + 1))
    for a in range(rows):
        best[:, a + 1, 1:] = np.maximum(best[:, a, 1:], best[:, a, :-1] + gain[:, a])
        np.maximum.accumulate(best[:, a + 1], axis=1, out=best[:, a + 1])
    k, a, b = np.arange(len(us)), n[us], m[us]
    while len(k):
        g = gain[k, a - 1, b - 1]
        take = np.isfinite(g) & (best[k, a, b] == best[k, a - 1, b - 1] + g)
        kept[pair[k[take], a[take] - 1, b[take] - 1]] = True
        up = take | (best[k, a, b] == best[k, a - 1, b])
        a, b = a - up, b - (take | ~up)
        going = (a > 0) & (b > 0)
        k, a, b = k[going], a[going], b[going]


def ordered_pairs(pairs: DataFrame, unit: list[str], floor: float = FLOOR) -> DataFrame:
    """The pairs (*unit, i, j, score) of each unit that align two sequences without crossing, by the greatest sum of margins over `floor`.

    A unit's pairs meet in one row; a task aligns many units at a time and holds one number for each pair of their rows, but for large units, which go one by one.
    """
    importable(pairs.sparkSession)
    others = [c for c in pairs.columns if c not in unit]
    units = pairs.groupBy(*unit).agg(F.collect_list(F.struct(*others)).alias("_pairs"))
    schema = pairs.select(*unit, *others).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(unit))
            many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            columns = dict(zip(others, lists.flatten().flatten(), strict=True))
            i, j, score = (columns[c].to_numpy(zero_copy_only=False) for c in ("i", "j", "score"))
            kept = np.flatnonzero(non_crossing_units(np.concatenate(([0], np.cumsum(many))), i, j, score, floor))
            of = pa.array(np.repeat(np.arange(len(many)), many)[kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in range(len(unit))), *(columns[c].take(pa.array(kept)) for c in others)], names=[*unit, *others])

    return units.mapInArrow(run, schema).select(*pairs.columns)


def learned_names(gold: DataFrame, made: DataFrame, pairs: DataFrame) -> DataFrame:
    """study, kind, made and gold: how a generated entity is called on the gold side, by the names of paired rows; of two the later row's."""
    name = lambda cells, row, to: cells.where("tier = 'identifier'").select("study", "unit", "kind", F.col("pos").alias(row), normal_text(F.col("value")).alias(to))
    both = pairs.select("study", "unit", "i", "j").join(name(gold, "i", "gold"), ["study", "unit", "i"]).join(name(made, "j", "made").drop("kind"), ["study", "unit", "j"])
    return both.where("gold <> '' and made <> ''").groupBy("study", "kind", "made").agg(F.max_by("gold", F.struct("i", "j")).alias("gold"))


def aligned(gold: DataFrame, made: DataFrame, layout: list[dict], codes: DataFrame | None = None, same: dict[str, list[str]] | None = None, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """The pairs (study, unit, i, j) of all units, and the names learned from them.

    Units are aligned in the layout's order, for all studies at once, so the steps are as many as a layout has units. Each
    rewrites its references by the names learned so far; a reference counts only when its kind has been seen, and never in the
    table that names its own kind. In the second pass units see names that later units taught in the first.
    """
    spark = gold.sparkSession
    frame = spark.createDataFrame([(r["unit"], r["header"], r["tier"], bool(r.get("multi")), r.get("kind"), r.get("literals") or [], bool(r.get("scope"))) for r in layout],
                                  "unit string, header string, tier string, multi boolean, kind string, literals array<string>, scope boolean")
    g, m = saved(with_layout(gold, frame)), saved(with_layout(made, frame))
    count = lambda cells, n: cells.groupBy("study", "unit").agg((F.max("pos") + 1).alias(n))
    sizes = saved(count(gold, "n_gold").join(count(made, "n_made"), ["study", "unit"]))
    g = saved(with_keys(g, None, codes, same))
    units = list(dict.fromkeys(r["unit"] for r in layout))
    names = spark.createDataFrame([], "study string, kind string, made string, gold string")
    names = gold.select("study").limit(0).join(names.drop("study"), F.lit(False))
    seen: set[str] = set()
    found: dict[str, DataFrame] = {}
    for _ in range(passes):
        for unit in units:
            rows = [r for r in layout if r["unit"] == unit]
            own = {r["kind"] for r in rows if r["tier"] == "identifier"}
            usable = (F.col("tier") != "identifier") & ((F.col("tier") != "reference") | F.col("kind").isin(*(seen - own), ""))
            keyed = saved(with_keys(m.where(F.col("unit") == unit), names, codes, same))
            scores = saved(row_scores(g.where(F.col("unit") == unit), keyed, sizes, usable))
            ordered = any(r.get("ordered") for r in rows)
            found[unit] = saved((ordered_pairs(scores, ["study", "unit"]) if ordered else best_pairs(scores, ["study", "unit"])).select("study", "unit", "i", "j"))
            if own:
                seen |= own
                fresh = learned_names(g, m, found[unit])
                names = saved(fresh.unionByName(names.join(fresh, ["study", "kind", "made"], "left_anti").select(*fresh.columns)))
    pairs = None
    for part in found.values():
        pairs = part if pairs is None else pairs.unionByName(part)
    return pairs, names


def tallies(gold: DataFrame, made: DataFrame, pairs: DataFrame, names: DataFrame, layout: DataFrame, codes: DataFrame | None = None, same: dict[str, list[str]] | None = None) -> DataFrame:
    """gold, generated, matched and slots by study, unit, header and tier, over paired rows and those without a partner.

    A cell counts the keys of each side, those that both have and all that any has. A text is one key, matched where
    the two are similar by AGREE or more.
    """
    g = with_keys(with_layout(gold, layout), None, codes, same).select("study", "unit", "header", "tier", F.col("pos").alias("i"), F.col("keys").alias("_g"), F.col("value").alias("g_text"))
    m = with_keys(with_layout(made, layout), names, codes, same).select("study", "unit", "header", "tier", F.col("pos").alias("j"), F.col("keys").alias("_m"), F.col("value").alias("m_text"))
    at = ["study", "unit", "j"]
    m = m.join(pairs.select("study", "unit", "i", "j"), at, "left").withColumn("_row", F.coalesce(F.col("i"), -1 - F.col("j")))
    met = lambda text: g.where(F.col("tier").eqNullSafe("text") == text).withColumn("_row", F.col("i")).drop("i").join(m.where(F.col("tier").eqNullSafe("text") == text).drop("i", "j"), ["study", "unit", "header", "tier", "_row"], "full")
    by, none = ["study", "unit", "header", "tier"], F.array().cast("array<string>")
    x, y = F.coalesce("_g", none), F.coalesce("_m", none)
    counted = lambda both, counts: both.groupBy(*by).agg(*(F.sum(c).alias(n) for n, c in zip(("gold", "generated", "matched", "slots"), counts, strict=True)))
    # only texts are met again after their scores, so only they are written
    others = counted(met(False), [F.size(x), F.size(y), F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))])
    both = saved(met(True).select(*by, "g_text", "m_text"))
    texts = text_scores(both.where("g_text is not null and m_text is not null").select("g_text", "m_text").distinct(), "g_text", "m_text")
    one = lambda c: F.col(c).isNotNull().cast("int")
    alike = (F.coalesce("similarity", F.lit(0.0)) >= AGREE).cast("int")
    return others.unionByName(counted(both.join(texts.drop("affinity"), ["g_text", "m_text"], "left"), [one("g_text"), one("m_text"), alike, F.lit(1)]))
