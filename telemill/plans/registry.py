"""The queries over the driver's tables, by name, with their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def near(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison. Sums differ in the last bit from run to run, so a tie at the last digit would fall on either side:
    a thousandth of that digit is added first, here and in the SQL (``steady``)."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 10.0 ** -(digits + 3), digits)


def steady(sql: str) -> str:
    """The SQL with every ``round(x, digits)`` made as ``near`` makes it."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            raise ValueError("round within round")
        depth, end, comma = 1, m.end(), None
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        digits = int(sql[comma + 1 : end - 1])
        out += f"{sql[at : m.end()]}({sql[m.end() : comma]}) + 1e-{digits + 3}, {digits})"
        at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as query ``name``, with its SQL where it has one."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = steady(sql)
        return function

    return register
