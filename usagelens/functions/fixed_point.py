"""Fixed-point arithmetic for report figures.

Report numbers are fixed point: shares, seconds and gigabytes are rounded half up from exact
integers.  Doubles would round differently from run to run (sums depend on task order) and from
engine to engine (145 ms is 0.14 s or 0.15 s), so every helper here works on integer counts of the
smallest unit.  Per-row helpers stay on ``bigint`` and inside generated code; helpers for aggregated
values use ``decimal(38,0)``, which costs nothing on a handful of rows.

The helpers take and return SQL expressions as text, for ``selectExpr`` and ``expr``: a report of a
hundred columns is then sent to the JVM as a hundred strings and not as thousands of calls.

All measures (bytes, milliseconds, partitions, counts) are non-negative.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor

MB = 1 << 20
GB = 1 << 30
TB = 1 << 40
MS_PER_SECOND = 1000
MS_PER_HOUR = 3600 * 1000

#: Ratios carry six decimals, i.e. they are counted in millionths.
MICROS = 1_000_000
MICROS_PER_PERCENT = 10_000

LIMB_BITS = 20


def divide_half_up(numerator: str, denominator: str | int, digits: int = 0) -> str:
    """``numerator / denominator`` in units of ``10**-digits``, rounded half up, as ``bigint``.

    NULL on a zero divisor, also in ANSI mode.  With a constant divisor only the remainder is scaled
    before the division, so a ``bigint`` numerator may have any value whose result is one.
    """
    factor = 2 * 10**digits
    if isinstance(denominator, int):
        whole = f"({numerator}) div {denominator}L"
        rest = f"((({numerator}) % {denominator}L) * {factor}L + {denominator}L) div {2 * denominator}L"
        return f"(({whole}) * {10**digits}L + ({rest}))"
    return f"((({numerator}) * {factor}L + ({denominator})) div nullif(({denominator}) * 2, 0))"


def as_decimal(units: str, digits: int) -> str:
    """Turn a count of ``10**-digits`` units into ``decimal(18, digits)``."""
    if digits == 0:
        return f"CAST({units} AS DECIMAL(18,0))"
    unit = f"0.{'0' * (digits - 1)}1"
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * {unit}BD AS DECIMAL(18,{digits}))"


def scaled(value: str, unit: int, digits: int) -> str:
    """Row-level ``round(value / unit, digits)`` of a ``bigint`` value."""
    return as_decimal(divide_half_up(value, unit, digits), digits)


def scaled_total(total: str, divisor: str | int, digits: int) -> str:
    """``round(total / divisor, digits)`` of an aggregated value of any size."""
    wide = f"CAST({total} AS DECIMAL(38,0))"
    return as_decimal(divide_half_up(wide, f"CAST({divisor} AS DECIMAL(38,0))", digits), digits)


def ratio_micros(part: str, whole: str) -> str:
    """``part / whole`` in millionths; NULL when ``whole`` is zero or either side is NULL."""
    return divide_half_up(part, whole, 6)


def percent_text(part: str, whole: str, digits: int) -> str:
    """Share of ``part`` in ``whole`` as text with a fixed number of decimals, e.g. ``12.50%``.

    The ratio is rounded to six decimals first, the percentage after that.  Both are aggregated counts
    of any size.
    """
    micros = ratio_micros(f"CAST({part} AS DECIMAL(38,0))", f"CAST({whole} AS DECIMAL(38,0))")
    percent = as_decimal(divide_half_up(micros, MICROS_PER_PERCENT, digits), digits)
    return f"concat(CAST({percent} AS STRING), '%')"


def count_where(condition: str) -> str:
    """Rows that meet a condition; compiles to less code than ``count_if``."""
    return f"count(CASE WHEN {condition} THEN 1 END)"


def exact_sum(value: str) -> str:
    """Exact sum of a ``bigint`` value as a decimal, without overflow.

    Byte totals of a large fleet pass 2**63, and a decimal accumulator allocates per row.  Two
    ``bigint`` sums, one of the high part and one of the low 20 bits, cannot overflow below 2**43
    rows and are added up once per group.
    """
    high = f"sum(shiftright({value}, {LIMB_BITS}))"
    low = f"sum(({value}) & {(1 << LIMB_BITS) - 1}L)"
    return f"(CAST({high} AS DECIMAL(20,0)) * {1 << LIMB_BITS}L + CAST({low} AS DECIMAL(20,0)))"


def human_bytes(total: str, count: str) -> str:
    """Mean size ``total / count`` in the largest fitting unit with one decimal.

    Sizes under 1 KB are given as plain bytes.  NULL when ``count`` is zero.
    """
    branches = []
    for unit, name in ((TB, "TB"), (GB, "GB"), (MB, "MB"), (1 << 10, "KB")):
        weight = f"CAST({count} AS DECIMAL(20,0)) * {unit}L"
        shown = f"concat(CAST({scaled_total(total, weight, 1)} AS STRING), ' {name}')"
        branches.append(f"WHEN {total} >= {weight} THEN {shown}")
    plain = f"CAST({scaled_total(total, count, 1)} AS STRING)"
    return f"CASE WHEN {count} = 0 THEN NULL {' '.join(branches)} ELSE {plain} END"


def smallest_raw_rounding_above(minimum: object, unit: int, digits: int) -> int:
    """Smallest integer ``x`` with ``round(x / unit, digits) > minimum``.

    Filters on a rounded figure become plain comparisons of the stored column, which reach the
    Parquet scan.
    """
    units = floor(Fraction(str(minimum)) * 10**digits) + 1
    return ceil(Fraction((2 * units - 1) * unit, 2 * 10**digits))


def largest_raw_rounding_to(maximum: object, unit: int, digits: int) -> int:
    """Largest integer ``x`` with ``round(x / unit, digits) <= maximum``."""
    return smallest_raw_rounding_above(maximum, unit, digits) - 1
