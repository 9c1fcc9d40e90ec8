"""Small lookups (round -> date, key -> range) used inside one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def looked_up(lookup: DataFrame, key: str, values: list[str]) -> Column:
    """A map from ``key`` to a struct of ``values``, as a scalar subquery.

    The lookup becomes part of the plan of its user: nothing runs while the query is
    built, the big side is neither shuffled nor joined, and any size gives the same
    plan. It is meant for levels of a report (survey rounds, names of columns), one row
    each. Missing keys look up nothing.
    """
    entry = F.struct(F.col(key), F.struct(*values))
    return lookup.where(F.col(key).isNotNull()).agg(F.map_from_entries(F.collect_list(entry))).scalar()
