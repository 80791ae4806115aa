"""Numbers in text, as column expressions: a cell that does not read is null, never a guess."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# Fixed values of the number format.
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
CURRENCY = r"(?i)(?:ر\.س|د\.إ|ج\.م|\b(?:usd|eur|gbp|sar|aed|egp|kwd|qar|omr|bhd)\b|[$€£¥₹﷼])"
HARD_SPACES = "   "
PLAIN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
#: The same as a match: one line end may follow, as ``$`` allows and a cast to a number takes.
PLAIN_LINE = PLAIN[:-1] + r"(?=(?:\r\n?|\n)?\z)"
GROUPED = r"^[+-]?\d{1,3}(?:(?:,\d{3})+|(?: \d{3})+)(?:\.\d+)?$"


def western(c: Column) -> Column:
    """Arabic and Persian digits as 0 to 9."""
    return F.translate(c, EASTERN_DIGITS, WESTERN_DIGITS)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.abs(c) < float("inf"), c)  # NaN counts as the largest number


def _finite_once(c: Column) -> Column:
    """``finite`` of a costly expression, which stands once in the result."""
    return F.get(F.filter(F.array(c), lambda x: F.abs(x) < float("inf")), F.lit(0))


def plain_number(c: Column) -> Column:
    """Unmapped cells: all commas go, then the rest must be a finite number."""
    # Each step names the one before once: where a filter or a fallback evaluates the whole expression, it is read once.
    return _read(F.replace(c, F.lit(","), F.lit("")))


def _read(c: Column) -> Column:
    """A cell that is a number without signs around it."""
    return _finite_once(F.regexp_extract(F.trim(c), PLAIN_LINE, 0).try_cast("double"))


def mapped_number(c: Column) -> Column:
    """Cells of a declared measure: currency, grouping, brackets and eastern digits are read; doubtful ones refused."""
    text = F.trim(c)
    # One chain without branches: each step names the one before once, so the expression stays short.
    t = F.translate(western(text), "٫٬−" + HARD_SPACES, ".,-" + " " * len(HARD_SPACES))
    t = F.regexp_replace(t, r"^\(\s*(.*?)\s*\)$", "$1")
    t = F.trim(F.regexp_replace(t, CURRENCY, ""))
    t = F.trim(F.regexp_replace(t, "%$", ""))
    number = F.regexp_replace(F.regexp_extract(t, f"{PLAIN}|{GROUPED}", 0), "[, ]", "").try_cast("double")
    return _finite_once(number * F.when(text.rlike(r"^\(.*\)$"), -1.0).otherwise(1.0))


def as_number(df: DataFrame, column: str) -> Column:
    """A column as a finite double: numbers as they are, text by the plain rule."""
    c = F.col(f"`{column}`")
    return finite(c.cast("double")) if isinstance(df.schema[column].dataType, NumericType) else plain_number(c.cast("string"))


def literal(value: object) -> float | None:
    """A filter's literal as a finite number, or None. Booleans are no numbers."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        number = float(value) if isinstance(value, (int, float)) else float(str(value).replace(",", ""))
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def key_number(c: Column) -> Column:
    """A join key compared as a number. Both rules read a bare number alike, so only other cells go through them."""
    return F.coalesce(_read(c), mapped_number(c), plain_number(c))


def key_text(c: Column, numeric: bool) -> Column:
    """A join key's canonical text: whole numbers without a point, text trimmed and case-sensitive, blank null."""
    if not numeric:
        return F.nullif(F.trim(c.cast("string")), F.lit(""))
    n = key_number(c.cast("string"))
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.round(n, 12).cast("string"), r"\.0$", ""))


def safe_ratio(num: Column, den: Column) -> Column:
    """A ratio that is null over 0 or null."""
    return F.try_divide(num, den)


def exact(c: Column, scale: int = 4) -> Column:
    """A double as a decimal, so that sums do not depend on the order of rows."""
    return c.cast(f"decimal(28,{scale})")


def exact_sum(c: Column, scale: int = 4) -> Column:
    return F.sum(exact(c, scale)).cast("double")
