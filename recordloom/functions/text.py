"""Column expressions over text: one per scalar rule, null in, null out unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What page numbering and the end of a sentence look like.
PAGE_LABEL = r"^((document\s+)?page\s*)?#{1,4}(\s*(of|/)\s*#{1,4})?$|^-\s*#{1,4}\s*-$"
SENTENCE_END = r"(?d)[,;]$|\.\s*$"


def folded(text: Column) -> Column:
    """Lower case with runs of ASCII white space as one space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")))


def title_key(text: Column) -> Column:
    """Lower case with everything but letters a-z and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: A word character on neither side; Java's \b would look at ASCII letters only.
_NOT_BESIDE_WORD = r"(?<![\p{L}\p{N}_])%s(?![\p{L}\p{N}_])"


def repeat_key(text: Column) -> Column:
    """Key under which running lines are the same: digits become # next to the word page and in short lines."""
    key = F.lower(text)
    return F.when(key.rlike(_NOT_BESIDE_WORD % "page") | (F.char_length(key) <= 12), F.regexp_replace(key, "[0-9]+", "#")).otherwise(key)


def is_page_label(key: Column) -> Column:
    """Whether a `repeat_key` is nothing but page numbering: #, page # of #, - # -."""
    return key.rlike(PAGE_LABEL)


def safe_name(text: Column, fallback: str = "item", most: int = 60) -> Column:
    """Commas, semicolons, quotes, tabs and line ends become spaces; at most so many characters; never empty."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[,;\"'\n\r\t]", " "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(F.rtrim(F.substring(plain, 1, most)), F.lit("")), F.lit(fallback))


def number_text(text: Column) -> Column:
    """A number of at most five decimals without thousands separators and trailing zeros; null if the text is no number."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,5})?$"), F.when(plain.contains("."), trimmed).otherwise(plain))


def items(text: Column) -> Column:
    """Comma-separated items: trimmed, blanks dropped, first of equals kept, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def display_cell(text: Column, most: int = 80) -> Column:
    """One line of at most so many characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def column_letter(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to ZZ."""
    letter = lambda n: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n + 1, F.lit(1))
    last = letter((index % 26).cast("int"))
    return F.when(index < 26, last).otherwise(F.concat(letter((F.floor(index / 26) - 1).cast("int")), last))


def cell_reference(column: Column, row: Column) -> Column:
    """A1 for column 0 and row 1."""
    return F.concat(column_letter(column), row.cast("string"))


def plausible_title(text: Column) -> Column:
    """At least two letters a-z, at most 160 characters and 22 words; begins with a digit, or its first letter is upper case; no sentence end."""
    return (
        text.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") & (F.char_length(text) <= 160) & (F.size(F.split(folded(text), " ")) <= 22)
        & text.rlike(r"^([0-9]|\P{L}*\p{Lu})") & ~text.rlike(SENTENCE_END)
    )
