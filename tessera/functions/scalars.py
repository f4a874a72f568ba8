"""Derived columns as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import null_unless


def year_digits(c: str | Column) -> Column:
    """H1: keep the digits and read them as an int ("TV Movie 2019" -> 2019).

    All digits are kept, so "2019-20" reads 201920 (D14); nothing left -> null.
    """
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^0-9]", "").try_cast("int")


def year_strict(c: str | Column) -> Column:
    """H2: int when the whole value parses, else null (D1: ``try_cast``)."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("int")


def in_range(c: Column, lo: int = 1870, hi: int = 2100) -> Column:
    """Optional plausibility check for parsed years (D14): null outside."""
    return null_unless(c.between(lo, hi), c)


def decade(year: str | Column) -> Column:
    """H3: truncating division by ten, times ten."""
    y = F.col(year) if isinstance(year, str) else year
    return (y / 10).cast("int") * 10


# Fixed values from the reference's derived features (year cut-offs and
# duration bands, in minutes).
RECENT_FROM_YEAR = 2015
CLASSIC_UNTIL_YEAR = 1980
SHORT_MAX = 90
MEDIUM_MAX = 120


def is_recent(year: str | Column, since: int = RECENT_FROM_YEAR) -> Column:
    """H4: 1.0 when year >= since, else 0.0 (null year -> 0.0)."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y >= since, F.lit(1.0)).otherwise(F.lit(0.0))


def is_old_classic(year: str | Column, until: int = CLASSIC_UNTIL_YEAR) -> Column:
    """H5: 1.0 when year <= until, else 0.0."""
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y <= until, F.lit(1.0)).otherwise(F.lit(0.0))


def duration_category(duration: str | Column, short_max: int = SHORT_MAX,
                      medium_max: int = MEDIUM_MAX) -> Column:
    """H6: short / medium / long (a null duration falls through to long)."""
    d = F.col(duration) if isinstance(duration, str) else duration
    return (F.when(d <= short_max, F.lit("short"))
            .when(d <= medium_max, F.lit("medium"))
            .otherwise(F.lit("long")))


def votes_per_review(votes: str, users: str, critics: str) -> Column:
    """H7: votes / (users + critics + 1), double division."""
    return F.col(votes).cast("double") / (F.col(users) + F.col(critics) + F.lit(1)).cast("double")


def review_ratio(users: str, critics: str) -> Column:
    """H8: users / (critics + 1)."""
    return F.col(users).cast("double") / (F.col(critics) + F.lit(1)).cast("double")


def log_votes(votes: str) -> Column:
    """H9: ln(1 + votes)."""
    return F.log1p(F.col(votes).cast("double"))


def abs_error(actual: str, predicted: str) -> Column:
    """H10."""
    return F.abs(F.col(actual) - F.col(predicted))


# Duration bins of the exploratory report (left-closed).
DURATION_BIN_EDGES = (80, 100, 120, 150, 200)
DURATION_BIN_LABELS = ("<80", "80-100", "100-120", "120-150", "150-200", ">200")


def duration_bin(duration: str | Column, edges=DURATION_BIN_EDGES,
                 labels=DURATION_BIN_LABELS) -> Column:
    """Labelled bins, left-closed: [80,100) -> "80-100"."""
    d = F.col(duration) if isinstance(duration, str) else duration
    expr = F.when(d.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        expr = expr.when(d < edge, F.lit(label))
    return expr.otherwise(F.lit(labels[len(edges)]))


def tenth_bin(label: str | Column) -> Column:
    """Lower 0.1 bin edge of a rating.

    ``int(x*10)/10`` with a rounding guard so 0.7*10 = 6.999... lands in 0.7
    (D3). The guard rounds x*10 to 6 places before flooring.
    """
    x = F.col(label) if isinstance(label, str) else label
    return F.floor(round_half_up(x * 10, 6)) / F.lit(10.0)


def width_bin(x: str | Column, lo: float, width: float) -> Column:
    """Equal-width bin index from a lower bound."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor((c - F.lit(lo)) / F.lit(width)).cast("long")


# Ensemble weights of ridge, forest and boosted trees.
BLEND_WEIGHTS = (0.2, 0.3, 0.5)


def blend(cols, weights=BLEND_WEIGHTS) -> Column:
    """Weighted sum of prediction columns."""
    expr = None
    for c, w in zip(cols, weights):
        term = F.col(c) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr


def row_id() -> Column:
    """Surrogate key inside one plan; never used to align two plans."""
    return F.monotonically_increasing_id()


def round_half_up(x: Column, digits: int) -> Column:
    """Round half-up on the value snapped to 10 decimals.

    Summation order moves a double by a few ulps; values that sit exactly on
    a rounding tie (common with decimal data) would then round either way.
    Snapping to decimal(38,10) first removes that noise, so every engine
    that rounds the same decimal gets the same digits. NaN, infinities and
    values beyond the decimal (1e28) are returned as they are.
    """
    return F.coalesce(F.round(x.try_cast("decimal(38,10)"), digits).cast("double"), x.cast("double"))


def pct(x: Column, n: Column, digits: int = 2) -> Column:
    """Percentage rounded to ``digits``; null of nothing (n = 0)."""
    return round_half_up(F.try_divide(F.lit(100.0) * x, n), digits)


# Money strings such as "$ 2250" or "INR 1000": a currency token
# (symbol or three letters) followed by an amount.
MONEY_PATTERN = r"^\s*([A-Z]{3}|[$€£¥])\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*$"


def money_currency(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    cur = F.regexp_extract(col, MONEY_PATTERN, 1)
    return F.when(cur != "", cur)


def money_amount(c: str | Column) -> Column:
    """Amount as decimal(18,2); anything that does not parse -> null."""
    col = F.col(c) if isinstance(c, str) else c
    amt = F.regexp_replace(F.regexp_extract(col, MONEY_PATTERN, 2), ",", "")
    return F.when(amt != "", amt).try_cast("decimal(18,2)")


def split_multi(c: str | Column, sep: str = r",\s*") -> Column:
    """Multi-valued text ("A, B, C") -> array of trimmed items."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(col, sep), lambda s: F.trim(s)), lambda s: s != "")
