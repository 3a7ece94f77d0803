"""Rules for titles, values, cells and grids as column expressions: null in, null out unless said otherwise."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of units with their singular, booleans, entities, title synonyms in their order, stopwords, prefixes of appendices, and shapes of keys.
UNITS = {
    "d": "day", "day": "day", "days": "day",
    "w": "week", "wk": "week", "wks": "week", "week": "week", "weeks": "week",
    "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "min": "minute", "mins": "minute", "minute": "minute", "minutes": "minute",
    "s": "second", "sec": "second", "second": "second", "seconds": "second",
    "mo": "month", "month": "month", "months": "month",
    "y": "year", "yr": "year", "yrs": "year", "year": "year", "years": "year",
}
TRUE, FALSE = ["y", "yes", "true", "t"], ["n", "no", "false", "f"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
SYNONYMS = [
    ("studies|study|clinical trial|protocol", "trial"),
    ("patients?|subjects?|participants?|volunteers?", "participant"),
    ("medications?|medicines?|drugs?(?!\\s+induced)", "therapy"),
    ("treatments?|interventions?|investigational products?", "intervention"),
    ("randomization", "randomisation"),
    ("utilization", "utilisation"),
    ("behavior", "behaviour"),
    ("compliance", "adherence"),
    ("withdrawals?|discontinuations?", "discontinuation"),
    ("assessments?|evaluations?|measures?|measurements?", "assessment"),
    ("analyses", "analysis"),
    ("schedule of events|schedule of assessments?|time and events", "schedule of activities"),
    ("flow ?charts?", "schedule of activities"),
]
STOPWORDS = "of the and for to in on a an with or by from at trial during after associated related its all".split()
APPENDIX = r"(?i)^(protocol\s+)?(appendix|attachment|annex)\s+[a-z0-9]{1,6}([.\-][a-z0-9]{1,6}){0,3}\.?\s*"
KEYS = [r"sk-[A-Za-z0-9_\-]{8,}", r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}"]


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def clean_text(text: Column) -> Column:
    """Compatibility forms folded, replacement, soft-hyphen and private-use characters dropped, white space folded."""
    plain = F.when(text.rlike("^[\\x00-\\x7F]*$"), text).otherwise(_compatible(text))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[\\x{FFFD}\\x{AD}\\p{Co}]", ""), r"(?U)\s+", " "))


def normal_text(text: Column) -> Column:
    """Tags out, the entities of ENTITIES decoded, white space and case folded, stops at the ends dropped."""
    plain = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, letter in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(F.trim(F.lower(F.regexp_replace(plain, r"(?U)\s+", " "))), "^[.;:]+|[.;:]+$", ""))


def normal_value(text: Column) -> Column:
    """Booleans as y and n; else numbers without needless zeros, units in the singular, other words, `..`; punctuation dropped."""
    plain = F.regexp_replace(normal_text(text), " 00:00:00$", "")
    unit = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))

    def canonical(word: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"^\+", ""), "^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1")
        number = F.regexp_replace(F.regexp_replace(bare, r"\.$", ""), "^-0$", "0")
        return F.when(word.rlike(r"^[+-]?[0-9]"), number).otherwise(F.coalesce(F.try_element_at(unit, word), word))

    words = F.regexp_extract_all(plain, F.lit(r"([+-]?[0-9]+(?:\.[0-9]+)?|\.\.|\p{L}+)"), F.lit(1))
    return F.when(plain.isin(TRUE), "y").when(plain.isin(FALSE), "n").otherwise(F.array_join(F.transform(words, canonical), " "))


def title_words(title: Column) -> Column:
    """A title for matching: synonyms rewritten in order, stopwords and numbers out, plural -s off words of five letters or more."""
    plain = F.regexp_replace(F.replace(F.lower(title), F.lit("&"), F.lit(" and ")), r"\(s\)|<#>|[{}]", "")
    plain = F.regexp_replace(plain, "[^a-z0-9]+", " ")
    for words, one in SYNONYMS:
        plain = F.regexp_replace(plain, rf"\b(?:{words})\b", one)
    kept = F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(STOPWORDS) & ~w.rlike("^[0-9]+$"))
    stem = lambda w: F.when((F.length(w) > 4) & w.rlike("s$") & ~w.rlike("(ss|is|us)$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_join(F.transform(kept, stem), " ")


def without_appendix(title: Column) -> Column:
    """The title without its appendix prefix; the whole title where nothing would be left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(title, APPENDIX, "")), F.lit("")), title)


def redacted(text: Column, secrets: list[str], mark: str = "***") -> Column:
    """Known secrets of eight characters or more, the longest first, and key-shaped strings replaced."""
    for secret in sorted({s for s in secrets if len(s) >= 8}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(mark))
    for shape in KEYS:
        text = F.regexp_replace(text, shape, mark.replace("$", "\\$"))
    return text


def lacks_reason(cell: Column) -> Column:
    """Whether an item of a comma-separated cell is Other without a reason after `=`."""
    return F.exists(F.split(cell, ","), lambda x: F.trim(x).rlike(r"(?i)^other\s*(=\s*)?$"))


def format_problem(kind: str, text: Column) -> Column:
    """Why a filled cell breaks its format (boolean, date, count, range), else null."""
    shapes = {
        "boolean": (r"(?i)^(y|n|yes|no|true|false|t|f)$", "must be Y or N"),
        "date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "must be a date as yyyy-mm-dd"),
        "count": (r"^[+-]?[0-9]+(\s*\.\.\s*[+-]?[0-9]+)?$", "must be a whole number or a range such as 280..320"),
        "range": (r"^[+-]?[0-9]+\s*\.\.\s*[+-]?[0-9]+( \s*.+)?$", "must be a range such as 18..75 YEARS"),
    }
    shape, why = shapes[kind]
    plain = F.trim(text)
    return F.when((plain != "") & ~plain.rlike(shape), why)


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern found in the text, case not looked at; null if none is."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for p, name in patterns))


def call_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input, output, cache_write, cache_read: tokens) and cost; prices per million tokens, unknown models cost nothing.

    Writing the cache costs 1.25 times, reading it a tenth of the input price.
    """
    both = usage.join(F.broadcast(prices.select("model", "price_in", "price_out")), "model", "left")  # one row a model
    cost = (F.col("input") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")) * F.col("price_in") + F.col("output") * F.col("price_out")
    return both.withColumn("cost", F.coalesce(F.round(cost / 1e6, 6), F.lit(0.0))).drop("price_in", "price_out")


def markdown(cells: Column) -> Column:
    """A grid (rows of cells) as a markdown table: short rows padded, bars escaped, null cells empty."""
    width = F.array_max(F.transform(cells, F.size))
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    made = F.transform(cells, row)
    return F.array_join(F.concat(F.slice(made, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))), F.slice(made, F.lit(2), F.size(made))), "\n")
