"""Building blocks for large expressions: literals in bulk, and computing a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONCE = "__once"


def sql_text(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: list[str]) -> str:
    """Strings as an SQL array; one parsed expression instead of a JVM call per literal."""
    items = ", ".join(sql_text(v) for v in values)
    return f"array({items})" if values else "cast(array() as array<string>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, whatever follows.

    Catalyst moves a filter below a projection by copying the projected
    expressions into it, so a filter on a score would score every text twice and
    copy the whole scoring plan for each use.  It does not move one below a
    generator, hence the one-element ``explode_outer``.
    """
    kept = [c for c in df.columns if c not in columns]
    value = F.struct(*[c.alias(name) for name, c in columns.items()])
    rows = df.select(*kept, F.explode_outer(F.array(value)).alias(ONCE))
    return rows.select(*kept, *[F.col(f"{ONCE}.{name}").alias(name) for name in columns])
