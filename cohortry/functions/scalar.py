"""Column expressions.

Every expression stays in the JVM.  Where the behaviour of a text or number
function differs between SQL engines, the docstring states which one is built.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit conversions and the calendar used for decimal ages.
CM_PER_INCH = 2.54
KG_PER_POUND = 0.453592
INCHES_PER_FOOT = 12
DAYS_PER_YEAR = 365.25
SEASON_CUTOFF = "09-15"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column | str) -> Column:
    """Number from text; text that is no number gives NULL."""
    return _col(c).try_cast("double")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division in double precision; a zero denominator gives NULL."""
    den = _col(den).cast("double")
    return _col(num).cast("double") / F.nullif(den, F.lit(0.0))


def round_ratio(num: Column | str, den: Column | str, digits: int = 2) -> Column:
    """A per-exposure rate: the numerator is rounded, divided, and rounded again."""
    return F.round(safe_div(F.round(_col(num).cast("double"), digits), den), digits)


def if_null(c: Column | str, value=0) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def season_year(season: Column | str) -> Column:
    """Closing year of a ``YYYY-YYYY`` season, as text."""
    return F.right(_col(season), F.lit(4))


def year_prefix(text: Column | str) -> Column:
    """First four characters."""
    return F.left(_col(text), F.lit(4))


def birth_year(dob: Column | str) -> Column:
    """Year of a birth date given as ``YYYY`` or ``YYYY-MM-DD``; NULL when unreadable."""
    return year_prefix(dob).try_cast("int")


def int_age(season: Column | str, dob: Column | str) -> Column:
    """Whole-year age in a season: closing year minus birth year."""
    return season_year(season).try_cast("int") - birth_year(dob)


def cutoff_date(year: Column | str, month_day: str = SEASON_CUTOFF) -> Column:
    return F.try_to_date(F.concat(_col(year).cast("string"), F.lit(f"-{month_day}")))


def decimal_age(as_of: Column, dob: Column | str) -> Column:
    """Age in years on a date, to two decimals; only for complete birth dates.

    ``try_to_date`` reads a bare year as 1 January, hence the length guard.
    An impossible date gives NULL.
    """
    dob = _col(dob)
    days = F.datediff(as_of, F.try_to_date(dob)).cast("double")
    return F.when(F.length(dob) > 4, F.round(days / F.lit(DAYS_PER_YEAR), 2))


def season_age(season: Column | str, dob: Column | str, month_day: str = SEASON_CUTOFF) -> Column:
    return decimal_age(cutoff_date(season_year(season), month_day), dob)


def age_on(date: str, dob: Column | str) -> Column:
    """Age on a fixed calendar date."""
    return decimal_age(F.lit(date).cast("date"), dob)


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def height_cm(text: Column | str) -> Column:
    """Whole centimetres from ``6' 2"`` or ``5' 11"``; any other form gives NULL."""
    pattern = r"""^(\d)' (\d{1,2})"$"""
    feet = F.regexp_extract(_col(text), pattern, 1).try_cast("int")
    inches = F.regexp_extract(_col(text), pattern, 2).try_cast("int")
    total = (feet * INCHES_PER_FOOT + inches).cast("double")
    return F.floor(total * F.lit(CM_PER_INCH)).cast("int")


def weight_kg(text: Column | str) -> Column:
    """Whole kilograms from whole pounds."""
    pounds = _col(text).try_cast("int").cast("double")
    return F.floor(pounds * F.lit(KG_PER_POUND)).cast("int")


def position_class(detail: Column | str) -> Column:
    """Detailed position to one of G, D, F; goalie wins over defence."""
    detail = _col(detail)
    return (
        F.when(detail.contains("G"), F.lit("G"))
        .when(detail.contains("D"), F.lit("D"))
        .when(detail.isNotNull(), F.lit("F"))
    )


def position_flag(pos: Column | str) -> Column:
    """1 for defence, 0 for everything else including NULL."""
    return F.when(_col(pos) == "D", 1).otherwise(0)


def truthy(c: Column | str) -> Column:
    """A number that is present and not zero."""
    c = _col(c)
    return c.isNotNull() & (c != 0)


def poly_eval(x2: Column | str, x1: Column | str, x0: Column | str, x: Column | str) -> Column:
    x = _col(x).cast("double")
    return _col(x2) * x * x + _col(x1) * x + _col(x0)


def json_path(doc: Column | str, path: str, kind: str = "string", default=None) -> Column:
    """A typed value inside a JSON text; missing or unreadable gives the default."""
    value = F.try_variant_get(F.try_parse_json(_col(doc)), path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two numeric arrays."""
    gaps = F.zip_with(_col(a), _col(b), lambda p, q: (p.cast("double") - q.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
