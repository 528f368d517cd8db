"""Null vocabularies, safe numbers, rounding guards and bands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as "no value", one list per input family.
NULL_WORDS = {
    "blank": ("",),
    "schema": ("", "none", "null"),
    "audit": ("", "none", "null", "[]", "unknown"),
    "training": ("", "null", "none", "[]"),
    "number": ("", "none", "null", "nan", "inf", "infinity"),
}
# Words read as booleans.
TRUE_WORDS = ("true", "1", "yes")
TRUE_WORDS_LIVE = ("true", "1", "yes", "oui")
NUMBER_TRUE_WORDS = ("true", "yes")
NUMBER_FALSE_WORDS = ("false", "no")

NUMBER_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_or_null(c: Column) -> Column:
    """Trimmed text, empty becomes null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first column that holds more than whitespace, untrimmed; '' when none does."""
    kept = [F.when(F.length(strip(c.cast("string"))) > 0, c.cast("string")) for c in columns]
    return F.coalesce(*kept, F.lit(""))


def is_null_like(c: Column, words: str = "schema") -> Column:
    text = F.lower(strip(c.cast("string")))
    return c.isNull() | text.isin(*NULL_WORDS[words])


def to_double(c: Column, words: str = "number", bool_words: bool = False) -> Column:
    """Number or null; text outside the plain number syntax is null, never an error."""
    text = strip(c.cast("string"))
    low = F.lower(text)
    number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    parsed = F.when(low.isin(*NULL_WORDS[words]), F.lit(None).cast("double")).otherwise(number)
    if bool_words:
        parsed = (
            F.when(low.isin(*NUMBER_TRUE_WORDS), F.lit(1.0)).when(low.isin(*NUMBER_FALSE_WORDS), F.lit(0.0)).otherwise(parsed)
        )
    return parsed


def to_double_or_zero(c: Column, words: str = "number", bool_words: bool = False) -> Column:
    return F.coalesce(to_double(c, words, bool_words), F.lit(0.0))


def to_int(c: Column) -> Column:
    """Whole-number text to bigint, anything else null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))


def to_flag(c: Column, words: tuple[str, ...] = TRUE_WORDS) -> Column:
    """True only for the listed words; null counts as false."""
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*words), F.lit(False))


def flag_to_double(c: Column) -> Column:
    return F.when(to_flag(c, TRUE_WORDS_LIVE), F.lit(1.0)).otherwise(F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def clamp(c: Column, low: float, high: float) -> Column:
    """The value cut to low .. high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, for formulas that use a costly value many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cap(c: Column, limit: float = 500.0) -> Column:
    return clamp(c, -limit, limit)


def ratio(num: Column, den: Column, digits: int | None = None, otherwise: float | None = None) -> Column:
    """num / den where den > 0, else `otherwise`."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    if digits is not None:
        value = half_even(value, digits)
    return F.when(den > 0, value).otherwise(F.lit(otherwise).cast("double"))


def confidence_band(freq: Column, high_inclusive: bool = True, missing: str | None = "unknown") -> Column:
    """low / medium / high at 0.55 and 0.75; the upper edge belongs to `high` or to `medium`."""
    high = freq >= 0.75 if high_inclusive else freq > 0.75
    return (
        F.when(freq.isNull(), F.lit(missing))
        .when(high, F.lit("high"))
        .when(freq >= 0.55, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def json_list(c: Column, element: T.DataType = T.StringType()) -> Column:
    """JSON text cell to array; null when it is not a JSON list."""
    return F.when(strip(c).startswith("["), F.from_json(c, T.ArrayType(element)))


def json_map(c: Column, value: T.DataType = T.DoubleType()) -> Column:
    return F.when(strip(c).startswith("{"), F.from_json(c, T.MapType(T.StringType(), value)))


def json_text(c: Column) -> Column:
    """Nested column to JSON text for flat sinks; null becomes ''."""
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(""))


def iso_utc(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, "UTC"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_seconds(c: Column) -> Column:
    return F.unix_seconds(c)


def short_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, as in '%g'."""
    size = F.abs(c)
    plain = F.when(size < 10, F.bround(c, 5)).when(size < 100, F.bround(c, 4)).when(size < 1000, F.bround(c, 3))
    plain = plain.when(size < 10000, F.bround(c, 2)).when(size < 100000, F.bround(c, 1)).otherwise(F.bround(c, 0))
    text = F.regexp_replace(plain.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.when(size >= 999999.5, F.regexp_replace(F.format_string("%.5e", c), r"\.?0+e", "e")).otherwise(text)
