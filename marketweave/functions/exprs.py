"""Column-expression helpers (cleaning, numeric, predicate functions).

All return ``Column`` objects built from ``pyspark.sql.functions`` so they
stay inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Exact money / quantity type used wherever a result is summed (float sums are
# order dependent, decimal sums are not).
MONEY = DecimalType(18, 4)
TOTAL = DecimalType(38, 4)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Double -> DECIMAL(18,4) (exact for inputs with <= 4 decimals)."""
    return col_(c).cast(MONEY)


def total(c) -> Column:
    """Fix the type of an aggregated money column to DECIMAL(38,4)."""
    return col_(c).cast(TOTAL)


def ratio(num, den, scale: int = 4) -> Column:
    """Average-like ratio of two exact sums, as a rounded double.

    Engines round decimal averages differently; a double built from exact
    sums and rounded to ``scale`` digits is the same everywhere.
    """
    den = F.nullif(col_(den).cast("double"), F.lit(0.0))
    return F.round(col_(num).cast("double") / den, scale)


def try_number(c, to: str = "double") -> Column:
    """Coercing numeric cast, malformed text -> NULL (ANSI-safe)."""
    return col_(c).try_cast(to)


def safe_div(num, den) -> Column:
    """Zero-safe division, x / 0 -> NULL."""
    return F.try_divide(col_(num), F.nullif(col_(den), F.lit(0)))


def blank_to_null(c) -> Column:
    """Empty or blank string -> NULL."""
    return F.nullif(F.trim(col_(c)), F.lit(""))


def map_values(c, mapping: Mapping[str, str], default: str | None = None,
               lower: bool = False) -> Column:
    """Dictionary lookup with an optional default for misses."""
    key = F.lower(col_(c)) if lower else col_(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, key)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def tag_by_lists(c, cases: Iterable[tuple[Iterable[str], str]], otherwise: str) -> Column:
    """First matching membership list wins, else ``otherwise``."""
    expr = None
    for values, tag in cases:
        cond = col_(c).isin(list(values))
        expr = F.when(cond, tag) if expr is None else expr.when(cond, tag)
    return expr.otherwise(otherwise) if expr is not None else F.lit(otherwise)


def contains_ci(c, pattern: str) -> Column:
    """Case-insensitive substring match (``LIKE '%p%'`` of SQLite)."""
    return col_(c).ilike(f"%{pattern}%")


def all_of(conds: Iterable[Column | None]) -> Column:
    """AND of the supplied predicates; ``None`` entries are skipped."""
    given = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def given(value) -> bool:
    """'Given' in the reference's sense: truthy (``''``, 0, None are not)."""
    return bool(value)


def missing_to_zero(c) -> Column:
    """NULL or NaN of a floating-point column -> 0."""
    return F.coalesce(F.nanvl(col_(c), F.lit(0.0)), F.lit(0.0))
