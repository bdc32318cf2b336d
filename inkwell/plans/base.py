"""A registry of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name in order of registration, with SQL where it can say the same."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return keep


def r6(x: Column | str) -> Column:
    """Rounded to six places, where both engines' last bits may differ."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)
