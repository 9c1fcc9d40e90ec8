"""Codes, labels and bands as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Answer codes of the surveys.
STATUS_CODES = {"N": 0, "P": 1, "S": 1}
CIRCUMCISION_CODES = {1: 1, 2: 0}
EVER_SEX_CODES = {1: 1, 8: 1, 2: 0}
SEX_LONG = {"F": "Female", "M": "Male"}
SEX_PLURAL = {"F": "Women", "M": "Men"}

# The age bandings. They disagree at age 50 and are kept apart.
REPORT_BANDS = dict(edges=(15, 25, 35, 50), labels=("15-24", "25-34", "35-49"), closed="left", outer=True)
FIVE_YEAR_BANDS = dict(edges=(15, 20, 25, 30, 35, 40, 45, 50), labels=None, closed="left", outer=False)
MODEL_BANDS = dict(edges=(0, 24, 34, 49), labels=("15-24", "25-34", "35-49"), closed="right", outer=False)
LABEL_START_BANDS = dict(
    edges=(14, 19, 24, 29, 34, 39, 44, 49),
    labels=("15-19", "20-24", "25-29", "30-34", "35-39", "40-44", "45-49"),
    closed="right",
    outer=False,
)


def band_labels(edges: Sequence[int], labels: Sequence[str] | None = None, closed: str = "left", outer: bool = False) -> list[str]:
    """Labels in level order; interval notation where none are given."""
    if labels is not None:
        return list(labels)
    left, right = ("[", ")") if closed == "left" else ("(", "]")
    return [f"{left}{a},{b}{right}" for a, b in zip(edges, edges[1:])]


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "\\'") + "'"


def band(value: str, edges: Sequence[int], labels: Sequence[str] | None = None, closed: str = "left", outer: bool = False) -> Column:
    """Label of the interval a value falls in, NULL outside all of them.

    ``value`` is a column name or SQL expression; ``outer`` also closes the open end of
    the outermost interval.
    """
    names = band_labels(edges, labels, closed, outer)
    branches = []
    for i, name in enumerate(names):
        if closed == "left":
            low, high = ">=", "<=" if outer and i == len(names) - 1 else "<"
        else:
            low, high = ">=" if outer and i == 0 else ">", "<="
        branches.append(f"WHEN {value} {low} {edges[i]} AND {value} {high} {edges[i + 1]} THEN {_literal(name)}")
    return F.expr(f"CASE {' '.join(branches)} END")


def level_code(label: str, levels: Sequence[str]) -> Column:
    """1-based position of a label among its levels, NULL when not a level."""
    return recode(label, {name: i + 1 for i, name in enumerate(levels)}, keep_other=False)


def recode(value: str, mapping: Mapping, keep_other: bool = True) -> Column:
    """Replace the listed values of a column or SQL expression; others stay, or turn NULL."""
    branches = " ".join(f"WHEN {_literal(old)} THEN {_literal(new)}" for old, new in mapping.items())
    return F.expr(f"CASE {value} {branches}{f' ELSE {value}' if keep_other else ''} END")


def digits(label: Column) -> Column:
    """First run of digits in a label such as ``R019`` as an integer, else NULL."""
    return F.regexp_extract(label, "([0-9]+)", 1).try_cast("int")


def label_start(label: Column) -> Column:
    """Lower edge printed in an interval label such as ``[15,20)``."""
    return F.substring(label, 2, 2).try_cast("int")


def label_part(label: Column, separator: str, index: int) -> Column:
    """One piece (from 0) of a label split at a literal separator, NULL if there is none."""
    return F.get(F.split(label, "\\Q" + separator + "\\E"), F.lit(index))


def within(value: Column, low, high) -> Column:
    """The value where it is plausible, NULL where it is not."""
    return F.when(value.between(low, high), value)


def is_in(value: Column, *options) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(value.isin(*options), F.lit(False))


def nan_to(value: Column, replacement: float) -> Column:
    return F.nanvl(value, F.lit(float(replacement)))
