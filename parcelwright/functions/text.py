"""Text expressions: numbers, labels and names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters and the Latin letters or digits they look like; codes of boundary stones; digits that read as digits upside down.
LOOKALIKES = "ЗзАаВвСсЕеНнКкМмОоРрТтХхУу"
MEANT = "33AaBbCcEeHhKkMmOoPpTtXxYy"
BOUNDARY_CODES = ("B", "BS", "RBS", "VBS", "RB", "RS")
UPSIDE_DOWN, RIGHT_WAY_UP = "69", "96"

NUMBER = r"^-?\d+(\.\d+)?$"


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def base_survey(c: Column) -> Column:
    """The first run of one to five digits."""
    return first_match(c, r"(\d{1,5})")


def latin_label(c: Column) -> Column:
    """A label with look-alike letters replaced."""
    return F.translate(c, LOOKALIKES, MEANT)


def comma_decimal(c: Column) -> Column:
    return F.translate(c, ".", ",")


def measured_value(c: Column) -> Column:
    """The first number with one or two decimals, with comma or dot, as a double."""
    return F.translate(first_match(c, r"(\d{1,4}[.,]\d{1,2})"), ",", ".").cast("double")


def clean_reading(c: Column) -> Column:
    """A reading stripped of parentheses, blanks and closing dots, with a decimal dot."""
    inner = F.regexp_replace(F.trim(c), r"^\(+|\)+$", "")
    return F.regexp_replace(F.translate(F.translate(inner, ",", "."), " ", ""), r"\.+$", "")


def checked_reading(c: Column, low: float = 0.1, high: float = 1000.0) -> Column:
    """struct(normalized, valid, reason) of a reading: reason is 'noise', 'out_of_range' or 'ok'."""
    text = clean_reading(c)
    value = F.when(text.rlike(NUMBER), text.cast("double"))
    reason = F.when(value.isNull(), "noise").when((value < low) | (value > high), "out_of_range").otherwise("ok")
    return F.struct(F.when(value.isNotNull(), text).alias("normalized"), (reason == "ok").alias("valid"), reason.alias("reason"))


def upside_down(c: Column) -> Column:
    """A number read upside down, or null if it has digits that can't be."""
    return F.when(c.rlike("^[01689]+$"), F.translate(F.reverse(c), UPSIDE_DOWN, RIGHT_WAY_UP))


def stone_label(c: Column) -> Column:
    """Whether a text is a stone's label: a letter A to H, or a number from 1 to 31."""
    return F.coalesce(c.rlike("^[A-H]$") | (c.rlike(r"^\d{1,2}$") & F.expr("true") & (F.when(c.rlike(r"^\d{1,2}$"), c.cast("int")).between(1, 31))), F.lit(False))


def boundary_code(c: Column) -> Column:
    """Whether one of a code's parts (split at hyphens and blanks) names a boundary stone."""
    return F.coalesce(F.exists(F.split(F.upper(c), r"[-\s]+"), lambda t: t.isin(*BOUNDARY_CODES)), F.lit(False))


def survey_options(reading: Column) -> Column:
    """The numbers that a misread text may mean: O, I and l read as digits, each run of digits and all runs together."""
    digits = F.translate(reading, "OoIl", "0011")
    runs = F.regexp_extract_all(digits, F.lit(r"(\d+)"), F.lit(1))
    return F.array_distinct(F.concat(runs, F.array(F.concat_ws("", runs))))


def known_survey(reading: Column, known: Column) -> Column:
    """The longest member of the array ``known`` that a misread text may mean (see survey_options()); long lists of known numbers go through matching.known_readings()."""
    hits = F.array_intersect(survey_options(reading), known)
    return F.get(F.array_sort(hits, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(0))


def local_name(c: Column) -> Column:
    """An XML tag without its namespace, in lower case."""
    return F.lower(F.substring_index(c, "}", -1))


def line_key(x: Column, y: Column) -> Column:
    """Key of a place: both coordinates rounded half to even."""
    return F.concat_ws(",", F.bround(x).cast("long").cast("string"), F.bround(y).cast("long").cast("string"))


def northing_easting(c: Column) -> Column:
    """struct(x, y) of a text that gives northing before easting; null with fewer than two numbers."""
    parts = F.split(F.trim(c), r"[\s,]+")
    return F.when(F.size(parts) >= 2, F.struct(F.get(parts, F.lit(1)).cast("double").alias("x"), F.get(parts, F.lit(0)).cast("double").alias("y")))


def lon_lat_list(c: Column) -> Column:
    """Points of a whitespace list of lon,lat[,alt]; short tokens are dropped."""
    tokens = F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda t: F.split(t, ",")), lambda t: F.size(t) >= 2)
    return F.transform(tokens, lambda t: F.struct(F.get(t, F.lit(0)).cast("double").alias("x"), F.get(t, F.lit(1)).cast("double").alias("y")))


def json_in_text(c: Column, schema: str) -> Column:
    """The first JSON array or object in a text, read by a schema; null where there is none or it doesn't parse."""
    return F.from_json(first_match(c, r"(?s)(\[.*\]|\{.*\})"), schema, {"mode": "PERMISSIVE"})


def kind_of_text(c: Column) -> Column:
    """What a text on a drawing is by its form: 'chain' (a length in parentheses), 'length', 'part' (digit, letter, perhaps a digit), 'stone', 'survey' (other whole numbers) or 'other'; null stays null."""
    t = F.trim(latin_label(c))
    return (
        F.when(t.rlike(r"^\(\d{1,4}[.,]\d{1,2}\)$"), "chain").when(t.rlike(r"^\d{1,4}[.,]\d{1,2}$"), "length").when(t.rlike(r"^\d[A-Za-z]\d?$"), "part")
        .when(stone_label(t), "stone").when(t.rlike(r"^\d{1,5}$"), "survey").when(t.isNotNull(), "other")
    )


def stated_scale(c: Column) -> Column:
    """The denominator of the first scale like 1:2000 in a text, as an int; null if there is none."""
    return F.replace(first_match(c, r"1\s*:\s*(\d{1,3}(?:,\d{3})+|\d{2,6})"), F.lit(","), F.lit("")).cast("int")


def listed_text(issues: Column, most: int = 5) -> Column:
    """The first ``most`` strings of an array on one line, and how many more there are; an empty text for none."""
    known = F.array_compact(issues)
    more = F.size(known) - most
    shown = F.array_join(F.slice(known, 1, most), "; ")
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(F.coalesce(shown, F.lit("")))


def first_coordinate(c: Column) -> Column:
    """struct(x, y): the first pair of numbers in the nested coordinates of a GeoJSON text; null if there is none."""
    pair = r"\[\s*(-?[\d.]+(?:[eE][-+]?\d+)?)\s*,\s*(-?[\d.]+(?:[eE][-+]?\d+)?)"
    return F.when(F.regexp_extract(c, pair, 1) != "", F.struct(F.regexp_extract(c, pair, 1).cast("double").alias("x"), F.regexp_extract(c, pair, 2).cast("double").alias("y")))


def check_line(name: Column, state: Column, detail: Column, width: int = 24) -> Column:
    """A line of a check report: the name padded to ``width``, the state in capitals, and the detail if there is one."""
    return F.concat(F.rpad(F.coalesce(name, F.lit("")), width, " "), F.upper(F.coalesce(state, F.lit("?"))), F.coalesce(F.concat(F.lit(": "), F.trim(detail)), F.lit("")))
