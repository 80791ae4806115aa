"""Dates in text, as column expressions, and period labels at a grain."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import western

GRAINS = ("day", "month", "quarter", "year")
#: An automatic grain has at most so many labels and is reached by at least this share of values.
MOST_LABELS, REACHED = 36, 0.9

# Month names by number, English and Arabic.
MONTH_NAMES = {
    1: ("january", "jan", "يناير", "كانون الثاني"),
    2: ("february", "feb", "فبراير", "شباط"),
    3: ("march", "mar", "مارس", "آذار"),
    4: ("april", "apr", "أبريل", "ابريل", "إبريل", "نيسان"),
    5: ("may", "مايو", "أيار", "ايار"),
    6: ("june", "jun", "يونيو", "يونيه", "حزيران"),
    7: ("july", "jul", "يوليو", "يوليه", "تموز"),
    8: ("august", "aug", "أغسطس", "اغسطس", "آب"),
    9: ("september", "sep", "sept", "سبتمبر", "أيلول", "ايلول"),
    10: ("october", "oct", "أكتوبر", "اكتوبر", "تشرين الأول"),
    11: ("november", "nov", "نوفمبر", "تشرين الثاني"),
    12: ("december", "dec", "ديسمبر", "كانون الأول"),
}

# The formats of a date, by what they give.
_TIME = r"(?:[ t]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?)?"
ISO_DAY = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + _TIME + "$"
ISO_MONTH = r"^(\d{4})[-/](\d{1,2})$"
MONTH_YEAR = r"^(\d{1,2})[-/](\d{4})$"
QUARTER = r"^(?:(\d{4})\s*[-/ ]?\s*q([1-4])|q([1-4])\s*[-/ ]?\s*(\d{4}))$"
YEAR = r"^(\d{4})$"
NUMERIC_DAY = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?:[ t]\d{1,2}:\d{2}(?::\d{2})?)?$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def normal(c: Column) -> Column:
    return F.regexp_replace(F.lower(western(F.trim(c))), "،", ",")


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")


def full_year(y: Column, text: Column | None = None) -> Column:
    """Two-digit years up to 68 are of this century."""
    return F.when(y >= 100, y).when(y <= 68, y + 2000).otherwise(y + 1900)


def _period(precision: str, y: Column, m: Column | None = None, d: Column | None = None, q: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    ok = y.between(1800, 2200)
    if precision == "month":
        ok = ok & m.between(1, 12)
    if precision == "day":
        ok = ok & F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd").isNotNull()
    made = F.struct(y.alias("y"), (m if m is not None else none).alias("m"), (d if d is not None else none).alias("d"), (q if q is not None else none).alias("q"), F.lit(precision).alias("precision"))
    return F.when(ok, made)


def _named(t: Column) -> Column:
    """A month's name among day and year: its number, then what is left after the name and separators go."""
    sep = F.lit(" ")
    padded = F.concat(sep, F.trim(F.regexp_replace(t, r"[\s,\-/.]+", " ")), sep)
    return let(padded, _named_words)


def _named_words(padded: Column) -> Column:
    names = sorted(((n, k) for k, v in MONTH_NAMES.items() for n in v), key=lambda x: (-len(x[0]), x[0]))
    any_name = f" (?:{'|'.join(n for n, _ in names)})(?= )"
    # Two names, as in "May June 2025", are no date.
    month = F.when(F.regexp_count(padded, F.lit(any_name)) == 1, F.coalesce(*[F.when(padded.contains(f" {n} "), F.lit(k)) for n, k in names]))
    rest = F.trim(F.regexp_replace(padded, any_name, ""))
    two = r"^(\d{1,2}) (\d{1,4})$"
    first4 = r"^(\d{4}) (\d{1,2})$"
    only = r"^(\d{4}|\d{2})$"

    def read(x: Column) -> Column:
        rest, month = x["rest"], x["month"]
        return F.coalesce(
            F.when(rest.rlike(only), _period("month", full_year(_part(rest, only, 1)), month)),
            F.when(rest.rlike(first4), _period("day", _part(rest, first4, 1), month, _part(rest, first4, 2))),
            F.when(rest.rlike(two), _period("day", full_year(_part(rest, two, 2)), month, _part(rest, two, 1))),
        )

    return let(F.struct(rest.alias("rest"), month.alias("month")), read)


def parse_date(c: Column, order: str = "day-first") -> Column:
    """struct(y, m, d, q, precision) of a cell, null where it does not read. ``order`` settles 03/04/2025; ``either``
    takes month-first where day-first is no date."""
    return let(normal(c), lambda t: _read(t, order))


def reads(c: Column) -> Column:
    """Whether a cell reads as a date in either order; a cell without a digit is not tried."""
    return F.coalesce(F.when(c.rlike(r"\p{Nd}"), parse_date(c, "either").isNotNull()), F.lit(False))


def _read(t: Column, order: str) -> Column:
    a, b, y = (_part(t, NUMERIC_DAY, k) for k in (1, 2, 3))
    day, month = (b, a) if order == "month-first" else (a, b)
    numeric = _period("day", full_year(y), month, day)
    if order == "either":
        numeric = F.coalesce(numeric, _period("day", full_year(y), day, month))
    quarter_year = F.coalesce(_part(t, QUARTER, 1), _part(t, QUARTER, 4))
    quarter = F.coalesce(_part(t, QUARTER, 2), _part(t, QUARTER, 3))
    return (
        F.when(t.rlike(ISO_DAY), _period("day", _part(t, ISO_DAY, 1), _part(t, ISO_DAY, 3), _part(t, ISO_DAY, 4)))
        .when(t.rlike(ISO_MONTH), _period("month", _part(t, ISO_MONTH, 1), _part(t, ISO_MONTH, 2)))
        .when(t.rlike(MONTH_YEAR), _period("month", _part(t, MONTH_YEAR, 2), _part(t, MONTH_YEAR, 1)))
        .when(t.rlike(QUARTER), _period("quarter", quarter_year, q=quarter))
        .when(t.rlike(YEAR), _period("year", _part(t, YEAR, 1)))
        .when(t.rlike(NUMERIC_DAY), numeric)
        .when(t.rlike(r"[a-z؀-ۿ]"), _named(t))
    )


def label(period: Column, grain: str) -> Column:
    """A period's sortable label; null if the value is coarser than the grain."""
    return let(period, lambda p: _label(p, grain))


def _label(p: Column, grain: str) -> Column:
    at = GRAINS.index(grain)
    fine = p["precision"].isin(*GRAINS[: at + 1])
    if grain == "day":
        text = F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])
    elif grain == "month":
        text = F.format_string("%04d-%02d", p["y"], p["m"])
    elif grain == "quarter":
        text = F.format_string("%04d-Q%d", p["y"], F.coalesce(p["q"], F.floor((p["m"] - 1) / 3).cast("int") + 1))
    else:
        text = F.format_string("%04d", p["y"])
    return F.when(fine, text)


def order_evidence(c: Column) -> list[Column]:
    """Aggregates that decide how a column writes day and month."""
    t = normal(c)
    a, b = _part(t, NUMERIC_DAY, 1), _part(t, NUMERIC_DAY, 2)
    count = lambda cond: F.count_if(t.rlike(NUMERIC_DAY) & cond)
    return [count((a > 12) & (b <= 12)).alias("day_first"), count((b > 12) & (a <= 12)).alias("month_first"), count((a != b) & (a <= 12) & (b <= 12)).alias("differs")]


def resolve_order(df: DataFrame, column: str, order: str = "auto") -> tuple[str, bool]:
    """(order, ambiguous): the proofs decide, the larger side where both exist; no proof is ambiguous if it matters."""
    if order != "auto":
        return order, False
    seen = df.agg(*order_evidence(F.col(column))).first()
    if seen["day_first"] or seen["month_first"]:
        return ("day-first" if seen["day_first"] >= seen["month_first"] else "month-first"), False
    return "day-first", bool(seen["differs"])


def grain_counts(df: DataFrame, period: Column) -> DataFrame:
    """n readable values; by grain, the values that reach it (n_...) and their labels (d_...). Each value is parsed once,
    for the count of equal periods, which are few; the labels are made of those."""
    cells = df.groupBy(period.alias("p")).agg(F.count("*").alias("n"))
    of = {g: label(F.col("p"), g) for g in GRAINS}
    values = lambda c: F.coalesce(F.sum(F.when(c.isNotNull(), F.col("n"))), F.lit(0))
    return cells.agg(values(F.col("p")).alias("n"), *[values(x).alias(f"n_{g}") for g, x in of.items()], *[F.count_distinct(x).alias(f"d_{g}") for g, x in of.items()])


def choose_grain(df: DataFrame, period: Column, grain: str = "auto") -> str:
    """The finest grain that nine in ten readable values reach, rolled up until the labels are few."""
    if grain != "auto":
        return grain
    seen = grain_counts(df, period).first()
    if not seen["n"]:
        return "month"
    start = next((i for i, g in enumerate(GRAINS) if seen[f"n_{g}"] >= REACHED * seen["n"]), len(GRAINS) - 1)
    return next((g for g in GRAINS[start:] if seen[f"d_{g}"] <= MOST_LABELS), "year")


def next_labels(last: str, count: int) -> list[str]:
    """Labels that continue the calendar of ``last``; ``next period +k`` where it is no calendar label."""
    parts = last.split("-")
    number = all(p.lstrip("Q").isdigit() for p in parts)
    steps = range(1, count + 1)
    if number and [len(p) for p in parts] == [4, 2, 2]:
        try:
            start = date.fromisoformat(last)
            return [(start + timedelta(days=k)).isoformat() for k in steps]
        except ValueError:
            pass
    elif number and len(parts) == 2 and len(parts[0]) == 4 and parts[1].startswith("Q"):
        first = int(parts[0]) * 4 + int(parts[1][1:]) - 1
        return [f"{(first + k) // 4:04d}-Q{(first + k) % 4 + 1}" for k in steps]
    elif number and [len(p) for p in parts] == [4, 2]:
        first = int(parts[0]) * 12 + int(parts[1]) - 1
        return [f"{(first + k) // 12:04d}-{(first + k) % 12 + 1:02d}" for k in steps]
    elif number and [len(p) for p in parts] == [4]:
        return [f"{int(last) + k:04d}" for k in steps]
    return [f"next period +{k}" for k in steps]
