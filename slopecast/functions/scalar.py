"""Numeric Column builders. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import inf, isinf

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    CLASS_EDGES,
    CLASS_NODATA,
    DOMAIN_RULES,
    NODATA_CODES,
    RAIN_THRESHOLDS,
    SEED,
    ClassScheme,
    Grid,
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def r6(value: Column | str) -> Column:
    """Round to six places without a negative zero."""
    return F.round(as_col(value), 6) + F.lit(0.0)


def all_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(lambda a, b: a & b, found) if found else F.lit(True)


def any_of(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def isclose(a: Column | str, b: Column | float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tolerance test that is false for missing and NaN operands."""
    a = as_col(a).cast("double")
    b = b if isinstance(b, Column) else F.lit(float(b))
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.coalesce(close & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def null_sentinels(value: Column | str, codes: Iterable[float] = NODATA_CODES, mode: str = "close") -> Column:
    """NaN, infinities and NoData codes become NULL; ``mode`` is ``close`` or ``exact``."""
    if mode not in ("close", "exact"):
        raise ValueError(f"unknown sentinel mode: {mode}")
    x = as_col(value).cast("double")
    return F.when(_finite(x) & _no_code(x, codes, mode), x)


def _finite(x: Column) -> Column:
    """False for infinities and for NaN, which orders above them."""
    return F.abs(x) < F.lit(inf)


def _no_code(x: Column, codes: Iterable[float], mode: str = "close") -> Column:
    """None of the codes, each under one literal tolerance; codes +c and -c share a test."""
    kept = list(codes)
    tests = []
    for code in kept:
        mirrored = code != 0 and -code in kept
        if mirrored and code < 0:
            continue
        away = F.abs(F.abs(x) - F.lit(code)) if mirrored else F.abs(x - F.lit(float(code)))
        tests.append(away > F.lit(1e-8 + 1e-5 * abs(code)) if mode == "close" else away != F.lit(0.0))
    return all_of(tests)


def usable(column: str, rules: dict[str, tuple[float, float]] = DOMAIN_RULES, codes: Iterable[float] = NODATA_CODES) -> Column:
    """Present, finite, no NoData code and inside its domain, as one small condition.

    Codes outside the domain need no test of their own, which keeps the filter on raw
    pixels short enough to be compiled.
    """
    x = F.col(column).cast("double")
    lo, hi = rules.get(column, (-inf, inf))
    inside = [code for code in codes if lo - 1e-5 * abs(code) <= code <= hi + 1e-5 * abs(code)]
    parts = [_no_code(x, inside)] if inside else []
    if column in rules:
        parts.append(_inside(column, lo, hi))
    if isinf(hi):
        parts.append(_finite(x))
    return F.coalesce(all_of(parts), F.lit(False))


def circular_encode(degrees: Column | str) -> tuple[Column, Column]:
    angle = F.radians(as_col(degrees).cast("double"))
    return F.sin(angle), F.cos(angle)


def pixel_to_lonlat(row: Column | str, col: Column | str, grid: Grid) -> tuple[Column, Column]:
    """Centre of a pixel."""
    x = F.lit(grid.c) + (as_col(col) + F.lit(0.5)) * F.lit(grid.a)
    y = F.lit(grid.f) + (as_col(row) + F.lit(0.5)) * F.lit(grid.e)
    return x, y


def lonlat_to_fraction(x: Column | str, y: Column | str, grid: Grid) -> tuple[Column, Column]:
    """Fractional (row, col) position, for display."""
    return (
        (F.lit(grid.f) - as_col(y)) / F.lit(-grid.e),
        (as_col(x) - F.lit(grid.c)) / F.lit(grid.a),
    )


def lonlat_to_pixel(x: Column | str, y: Column | str, grid: Grid) -> tuple[Column, Column]:
    """(row, col) of the pixel that contains a position."""
    return (
        F.floor((as_col(y) - F.lit(grid.f)) / F.lit(grid.e)).cast("int"),
        F.floor((as_col(x) - F.lit(grid.c)) / F.lit(grid.a)).cast("int"),
    )


def digitize(value: Column | str, edges: list[float] = CLASS_EDGES, nodata: int = CLASS_NODATA) -> Column:
    """1-based left-closed class over the inner edges; missing values take ``nodata``."""
    x = as_col(value)
    steps = sum((F.when(x >= F.lit(edge), 1).otherwise(0) for edge in edges[1:-1]), F.lit(1))
    return F.when(x.isNull() | F.isnan(x), F.lit(nodata)).otherwise(steps).cast("int")


def class_label(value: Column | str, scheme: ClassScheme) -> Column:
    """Label of a 1-based class; NULL outside the scheme."""
    pairs = [item for i, label in enumerate(scheme.labels, start=1) for item in (F.lit(i), F.lit(label))]
    return F.create_map(*pairs)[as_col(value)]


def clip(value: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    x = as_col(value)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def window_trigger(rain: Column | str, hours: int) -> Column:
    return clip(as_col(rain) / F.lit(RAIN_THRESHOLDS[hours]))


def trigger_score(totals: dict[int, Column | str]) -> Column:
    """Highest clipped share of its threshold that any trailing total reaches."""
    parts = [window_trigger(rain, hours) for hours, rain in totals.items()]
    return F.when(all_of(p.isNotNull() for p in parts), F.greatest(*parts))


def risk_formula(score: Column | str, trigger: Column | str) -> Column:
    s, r = as_col(score), as_col(trigger)
    return clip(F.lit(0.65) * s + F.lit(0.35) * r + F.lit(0.25) * s * r)


def _inside(column: str, lo: float, hi: float) -> Column:
    c = F.col(column)
    low = c >= F.lit(lo)
    return low if isinf(hi) else low & (c <= F.lit(hi))


def domain_conditions(columns: Iterable[str], rules: dict[str, tuple[float, float]] = DOMAIN_RULES) -> dict[str, Column]:
    """Column -> "inside its inclusive bounds"; NULL where the value is missing."""
    present = list(columns)
    return {c: _inside(c, lo, hi) for c, (lo, hi) in rules.items() if c in present}


def reason_string(failures: dict[str, Column], suffix: str) -> Column:
    """Names of the failed checks joined by semicolons."""
    return F.concat_ws(";", *[F.when(bad, F.lit(f"{name}_{suffix}")) for name, bad in failures.items()])


def hash_key(key: Column | str, seed: int = SEED) -> Column:
    """Layout-independent random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))


def significance(p: Column | str) -> Column:
    p = as_col(p)
    return (
        F.when(p < F.lit(0.001), "***").when(p < F.lit(0.01), "**").when(p < F.lit(0.05), "*").when(p.isNotNull(), "ns")
    )


def missing_flag(percent: Column | str) -> Column:
    p = as_col(percent)
    return F.when(p > F.lit(40.0), "RED").when(p > F.lit(20.0), "ORANGE").otherwise("GREEN")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
