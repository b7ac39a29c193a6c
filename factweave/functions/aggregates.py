"""Aggregates of one's own: a name to a function from a Column to an aggregate Column.

``THE <name> OF x`` then works as the built-in ones do, grouped, WITHIN, or over
a bag. A pandas grouped-aggregate UDF is a function from a Column to a Column too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

AGGREGATES: dict[str, Callable[[Column], Column]] = {}


def register(name: str, function: Callable[[Column], Column]) -> None:
    AGGREGATES[name.lower()] = function
