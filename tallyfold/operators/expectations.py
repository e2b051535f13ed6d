"""Data-quality expectations: each gives the violating rows; a suite counts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """Q1, Q6."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def is_missing(col: str) -> Column:
    """Q2."""
    return F.col(col).isNull()


def not_null(df: DataFrame, col: str) -> DataFrame:
    """Q2."""
    return df.where(is_missing(col))


def related(df: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """Q3."""
    return df.where(F.col(col).isNotNull()).join(parent.select(F.col(key).alias("__k")).distinct(), F.col(col) == F.col("__k"), "left_anti")


def is_other(col: str, values: list) -> Column:
    """Q4: a value that is none of `values`."""
    return F.col(col).isNotNull() & ~F.col(col).isin(values)


def accepted(df: DataFrame, col: str, values: list) -> DataFrame:
    """Q4."""
    return df.where(is_other(col, values))


def is_outside(col: str, low: float | None = None, high: float | None = None, inclusive: bool = True) -> Column:
    """Q5."""
    c = F.col(col)
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((c < low) if inclusive else (c <= low))
    if high is not None:
        bad = bad | ((c > high) if inclusive else (c >= high))
    return bad


def in_range(df: DataFrame, col: str, low: float | None = None, high: float | None = None, inclusive: bool = True) -> DataFrame:
    """Q5."""
    return df.where(is_outside(col, low, high, inclusive))


def costs_unheld(qty: str = "qty", cost: str = "cost") -> Column:
    """Q7."""
    return (F.abs(qty) <= 1e-9) & (F.abs(cost) > 1e-6)


def zero_when_not_held(positions: DataFrame, qty: str = "qty", cost: str = "cost") -> DataFrame:
    """Q7."""
    return positions.where(costs_unheld(qty, cost))


def one_current(versions: DataFrame, key: str) -> DataFrame:
    """Q8."""
    return unique(versions.where("is_current"), key)


def violated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """expectation, n_violations of conditions on single rows (Q2, Q4, Q5, Q7 as columns), in one scan."""
    counts = rows.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    each = F.array(*[F.struct(F.lit(name).alias("expectation"), F.col(f"c{i}").alias("n_violations")) for i, name in enumerate(checks)])
    return counts.select(F.inline(each))


def suite(checks: dict[str, DataFrame], *counted: DataFrame) -> DataFrame:
    """expectation, n_violations: of each check that needs rows of its own, and what `violated` has counted."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("expectation"), "n_violations")
        out = one if out is None else out.unionByName(one)
    for one in counted:
        out = one if out is None else out.unionByName(one)
    return out
