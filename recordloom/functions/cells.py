"""What stands in cells: formats and their problems, quantities, cell texts, addresses, escapes. Null in, null out unless said otherwise."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import number_text

# Shapes of formatted values, words for yes and no, and units of time.
QUANTITY = r"(?s)^([+-]?[0-9]+)(\.[0-9]{0,5})?(\s*([^\n]+))?$"
RANGE = r"^([+-]?[0-9]+)(\s*\.\.\s*([+-]?[0-9]+))?( \s*(.+))?$"
BOOLEANS = ["true", "yes", "1", "y", "t", "false", "no", "0", "n", "f"]
YES, NO = ["yes", "y", "true"], ["no", "n", "false"]
TIME_UNITS = "years yrs yr year y months mths mth month mnths mnth weeks wks wk week w days dys dy day d hours hrs hr hour h minutes mins min minute m seconds secs sec second s".split()
FORMATS = ["boolean", "date", "quantity", "count", "range", "geographic_scope", "enrollment", "duration", "window"]


def with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows with _units: from every name of a unit (upper case) to what is written for it. units: code, preferred and submission of each.

    Codes come before preferred terms before submission values. The units are a dictionary of a code list: one row, sent to every task.
    """
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("by"), F.upper(c).alias("name")) for i, c in enumerate(("code", "preferred", "submission")))))
    each = units.select("submission", names.alias("n")).where("coalesce(n.name, '') <> ''")
    best = each.groupBy("n.name").agg(F.min_by("submission", F.struct("n.by", "submission")).alias("submission"))
    return rows.crossJoin(F.broadcast(best.agg(F.map_from_entries(F.collect_list(F.struct("name", "submission"))).alias("_units"))))


def _unit(phrase: Column, plural: bool = True) -> Column:
    """What is written for a unit; null if it is none. plural: it may have an s more."""
    name = F.upper(F.trim(phrase))
    found = F.try_element_at("_units", name)
    return F.coalesce(found, F.when(F.endswith(name, F.lit("S")), F.try_element_at("_units", F.regexp_replace(name, "S$", "")))) if plural else found


def format_quantity(value: Column, unit: Column) -> Column:
    """`125 mg` for a number and a unit, on rows of `with_units`; an unknown unit stays as it is, none is left out, no number gives null."""
    number, given = number_text(value), F.nullif(F.trim(unit), F.lit(""))
    return F.when(number.isNotNull(), F.concat_ws(" ", number, F.coalesce(_unit(given), given)))


def format_range(lower: Column, upper: Column, unit: Column) -> Column:
    """`18..75 YEARS`, on rows of `with_units`; both ends have to be numbers."""
    low, high, given = number_text(lower), number_text(upper), F.nullif(F.trim(unit), F.lit(""))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws(" ", F.concat(low, F.lit(".."), high), F.coalesce(_unit(given), given)))


def format_boolean(value: Column) -> Column:
    return F.when(value, "Y").when(~value, "N")


def format_count(lower: Column, upper: Column) -> Column:
    """A number, or `lower..upper` where both are; a text that is no number stays for the reviewer."""
    low, high = number_text(lower), number_text(upper)
    return F.when(low.isNull(), lower).otherwise(F.concat_ws("..", low, high))


def flag(answer: Column) -> Column:
    """Y or N of yes and no words, else null."""
    word = F.lower(F.trim(answer))
    return F.when(word.isin(YES), "Y").when(word.isin(NO), "N")


def planned_sex(terms: Column) -> Column:
    """`Female, Male` where Both is among comma-separated terms, else the terms."""
    return F.when(F.exists(F.split(terms, ","), lambda t: F.trim(t) == "Both"), "Female, Male").otherwise(terms)


def _parted(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _quantity_problem(text: Column) -> Column:
    """blocking and message of what is wrong with a quantity."""
    problem = lambda blocking, why: F.struct(F.lit(blocking).alias("blocking"), (F.lit(why) if isinstance(why, str) else why).alias("message"))
    unit = F.trim(F.regexp_extract(text, QUANTITY, 4))
    lost = F.regexp_replace(F.regexp_extract(text, QUANTITY, 2), "[.0]", "") != ""
    return (
        F.when(~text.rlike(QUANTITY), problem(True, "must be a number optionally followed by a unit, e.g. 125 mg"))
        .when((unit != "") & _unit(unit, False).isNull(), problem(True, F.concat(F.lit("unit '"), unit, F.lit("' is not a known unit"))))
        .when(lost, problem(False, "the decimal part is dropped by the importer"))
    )


def format_problem(kind: Column, value: Column) -> Column:
    """blocking and message of what is wrong with a filled value of one of FORMATS, on rows of `with_units`; null if nothing is.

    Only decimals of a quantity are a warning; all else blocks.
    """
    text = F.trim(value)
    problem = lambda why: F.struct(F.lit(True).alias("blocking"), (F.lit(why) if isinstance(why, str) else why).alias("message"))
    part = lambda n: F.trim(F.regexp_extract(text, RANGE, n))
    unknown = lambda unit: problem(F.concat(F.lit("unit '"), unit, F.lit("' is not a known unit")))
    whole = r"^[+-]?[0-9]+$"
    count = F.when(F.contains(text, F.lit("..")), F.when(~(text.rlike(RANGE) & (part(5) == "")), problem("must be a whole number or a range such as 280..320"))).when(~text.rlike(whole), problem("must be a whole number"))
    span = F.when(~text.rlike(RANGE) | (part(3) == ""), problem("must be lower..upper followed by a unit, e.g. 18..75 YEARS")).when(part(5) == "", problem("needs a unit after the range, e.g. 18..75 YEARS")).when(_unit(part(5)).isNull(), unknown(part(5)))
    window = F.when(~text.rlike(RANGE) | (part(3) == "") | (part(5) == ""), problem("must be lower..upper and a time unit, e.g. -3..3 days")).when(~F.lower(part(5)).isin(TIME_UNITS), problem(F.concat(F.lit("unit '"), part(5), F.lit("' is not a time unit")))).when(_unit(part(5)).isNull(), unknown(part(5)))
    lasting = F.when(~text.rlike(r"^[0-9]+\s*[A-Za-z]+$") | ~F.lower(F.regexp_extract(text, "([A-Za-z]+)$", 1)).isin(TIME_UNITS), problem("must be a whole number and a time unit, e.g. 2 weeks"))

    def scope(item: Column) -> Column:
        parts = F.split(item, ":")
        key = F.upper(F.trim(F.get(parts, F.lit(0))))
        named = key.isin("REGION", "COUNTRY") & (F.size(parts) == 2) & (F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))) != "")
        return F.when(~(((key == "GLOBAL") & (F.size(parts) == 1)) | named), problem(F.concat(F.lit("'"), item, F.lit("' must be Global, Region: <name> or Country: <code>"))))

    def enrolled(item: Column) -> Column:
        parts = F.split(item, ":")
        key, rest = F.upper(F.trim(F.get(parts, F.lit(0)))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        number = _quantity_problem(rest)
        named = F.trim(F.regexp_extract(rest, "^([^=]*)=", 1))
        quoted = F.concat(F.lit("'"), item, F.lit("'"))
        return (
            F.when(F.size(parts) != 2, problem(F.concat(quoted, F.lit(" must look like Global: 300 or Country: GBR=40"))))
            .when(key == "GLOBAL", F.when(number.isNotNull(), problem(F.concat(quoted, F.lit(": the number "), number["message"]))))
            .when(key.isin("REGION", "COUNTRY", "COHORT", "SITE"), F.when((named == "") | ~F.trim(F.regexp_extract(rest, "=(.*)$", 1)).rlike(whole), problem(F.concat(quoted, F.lit(" must look like "), F.initcap(key), F.lit(": <name>=<number>")))))
            .otherwise(problem(F.concat(quoted, F.lit(" must start with Global, Region, Country, Cohort or Site"))))
        )

    first = lambda rule: F.get(F.filter(F.transform(_parted(text), rule), lambda p: p.isNotNull()), F.lit(0))
    told = (
        F.when(kind == "boolean", F.when(~F.lower(text).isin(BOOLEANS), problem("must be Y or N")))
        .when(kind == "date", F.when(~text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), problem("must be a date as yyyy-mm-dd")))
        .when(kind == "quantity", _quantity_problem(text)).when(kind == "count", count).when(kind == "range", span)
        .when(kind == "geographic_scope", first(scope)).when(kind == "enrollment", first(enrolled)).when(kind == "duration", lasting).when(kind == "window", window)
    )
    return F.when(F.coalesce(text, F.lit("")) != "", told)


def other_reason(item: Column) -> Column:
    """The reason in `Other = reason`; null for other items and where there is none."""
    return F.when(item.rlike(r"(?is)^\s*other\s*="), F.nullif(F.trim(F.regexp_extract(item, "(?s)=(.*)$", 1)), F.lit("")))


def cell_text(value: Column, preferred: Column, exact: Column, multi: Column, other: Column, kind: Column, marked_up: Column) -> Column:
    """What is written for a value; '' for none.

    An exact term is written as its preferred terms, if there are as many as items (multi: items are comma-separated), with the reason of an Other item where such are
    allowed, which also joins terms without a space. Dates get a time of day; texts of marked-up cells become a paragraph, escaped.
    """
    text, terms = F.trim(value), F.transform(F.split(preferred, ", "), lambda t: F.trim(t))
    items = F.when(multi, _parted(text)).otherwise(F.array(text))
    written = F.zip_with(items, terms, lambda i, t: F.when(other & F.lower(i).startswith("other") & F.contains(i, F.lit("=")), F.concat(t, F.lit("="), F.trim(F.regexp_extract(i, "(?s)=(.*)$", 1)))).otherwise(t))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    as_terms = exact & (F.coalesce(preferred, F.lit("")) != "") & (F.size(items) == F.size(terms))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when(F.coalesce(as_terms, F.lit(False)), F.when(other, F.array_join(written, ",")).otherwise(F.array_join(written, ", ")))
        .when(kind == "date", F.concat(text, F.lit(" 00:00:00"))).when(marked_up, F.concat(F.lit("<p>"), safe, F.lit("</p>"))).otherwise(text)
    )


def address(lines: Column, district: Column, city: Column, state: Column, postal: Column, country: Column) -> Column:
    """`lines|district|city|state|postal code|country`, bars in lines as spaces; null without a city or a country (a code that is known)."""
    given = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(F.replace(x, F.lit("|"), F.lit(" ")))), lambda x: x != "")
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("")))
    whole = F.array_join(F.concat(first, F.array(part(district), part(city), part(state), part(postal), part(country))), "|")
    return F.when((F.coalesce(city, F.lit("")) != "") & country.isNotNull(), whole)


def decoded_escapes(text: Column) -> Column:
    r"""Text in which \uXXXX, written as six characters, is the character; runs of them are decoded together, so that pairs make one."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1)), lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
    return F.array_join(F.zip_with(F.split(text, run), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def decoded_leaves(df: DataFrame) -> DataFrame:
    """df with `decoded_escapes` applied to every string in it, however deep in arrays, structs and values of maps."""

    def leaf(value: Column, kind) -> Column:
        name = kind.typeName()
        if name == "string":
            return decoded_escapes(value)
        if name == "array":
            return F.transform(value, lambda x: leaf(x, kind.elementType))
        if name == "map":
            return F.transform_values(value, lambda _, x: leaf(x, kind.valueType))
        if name == "struct":
            return F.when(value.isNotNull(), F.struct(*(leaf(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return value

    return df.select(*(leaf(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
