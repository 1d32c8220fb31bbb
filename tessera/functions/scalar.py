"""Column expressions of panel analytics. None of them makes NaN: what is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for no data, and the months of the four-month seasons.
NO_DATA = ("", "nan", "NaN", "None", "<NA>", "-1")
UNASSIGNED = "s-1"
SEASONS = {"DJFM": (12, 1, 2, 3), "AMJJ": (4, 5, 6, 7), "ASON": (8, 9, 10, 11)}


def recode_boolean(c: Column) -> Column:
    """``"True"`` and ``"False"`` as 1 and 0; any other text stays."""
    return F.when(c == "True", "1").when(c == "False", "0").otherwise(c)


def threshold_flag(c: Column, least: float) -> Column:
    """1 if the value reaches ``least``; null counts as below."""
    return F.coalesce((c >= least).cast("int"), F.lit(0))


def season_of(month: Column) -> Column:
    out = F
    for name, months in SEASONS.items():
        out = out.when(month.isin(*months), name)
    return out


def season_year(year: Column, month: Column) -> Column:
    """December belongs to the next year's first season."""
    return year + (month == 12).cast("int")


def quarter_of_month(month: Column) -> Column:
    return F.floor((month - 1) / 3).cast("int") + 1


def year_quarter(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def to_double(c: Column) -> Column:
    """A number from text, null where there is none."""
    return finite_or_null(c.try_cast("double"))


def to_int(c: Column) -> Column:
    """Text as a whole number, 0 where there is none."""
    return F.coalesce(finite_or_null(c.try_cast("double")).cast("bigint"), F.lit(0).cast("bigint"))


def plain_code(c: Column) -> Column:
    """A unit code as text without blanks around it and without a trailing ``.0``."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def known_code(c: Column, *more: str) -> Column:
    """Null where the text is one of the no-data tokens."""
    return F.when(F.trim(c).isin(*NO_DATA, UNASSIGNED, *more), None).otherwise(F.trim(c))


def with_prefix(c: Column, prefix: str = "s") -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def branch_or_root(c: Column) -> Column:
    """A binary path, or ``root`` for anything else and null."""
    return F.when(c.rlike("^([01]+|root)$"), c).otherwise(F.lit("root"))


def branch_of_index(index: Column, depth: int) -> Column:
    """The ``depth`` binary digits of a node's place in its level; the root's path is empty."""
    return F.lpad(F.bin(index), depth, "0") if depth else F.lit("")


def index_of_branch(branch: Column) -> Column:
    return F.when(branch == "", F.lit(0)).otherwise(F.conv(branch, 2, 10).cast("bigint"))


def plan_name(variant: Column, year: Column, month: Column, scope: Column) -> Column:
    """``variant_yyyy_mm_fsN``."""
    return F.concat_ws("_", variant, year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.concat(F.lit("fs"), scope.cast("string")))


def logit(p: Column, edge: float = 1e-6) -> Column:
    c = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(c / (1 - c))


def logit_gain(f1: Column, base: Column) -> Column:
    """How far a plan's F1 is above its base in log-odds, 0 if it isn't."""
    return F.greatest(logit(f1) - logit(base), F.lit(0.0))


def grid_cell(x: Column, y: Column, x0: Column, y0: Column, step: float, columns: Column) -> Column:
    return F.floor((x - x0) / step) * columns + F.floor((y - y0) / step)


def haversine_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle angle in degrees."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.degrees(2 * F.asin(F.least(F.sqrt(a), F.lit(1.0))))


def gaussian_kernel(distance: Column, sigma: float = 5.0) -> Column:
    return F.exp(-(distance**2) / (2 * sigma**2))


def relative_change(new: Column, old: Column) -> Column:
    """``(new - old) / old``, null where old is null or 0."""
    return F.try_divide(new - old, old)


def symmetric_bound(low: Column, high: Column) -> Column:
    return F.greatest(F.abs(low), F.abs(high))


def region_of(country: Column, regions: dict[str, str]) -> Column:
    """The region of a country by a literal map, ``Other`` where there is none."""
    pairs = [F.lit(x) for kv in regions.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[country], F.lit("Other"))
