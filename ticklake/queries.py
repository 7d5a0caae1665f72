"""Registry of the engine's queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, rounded: str = "") -> Callable:
    """Registers a query; the columns named in rounded are rounded to six places on both sides (minus zero is zero)."""
    names = rounded.split()

    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = query(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names}) if names else out

        run.__name__, run.__doc__ = name, query.__doc__
        QUERIES[name] = run
        if sql is not None:
            fixed = ", ".join(f"CASE WHEN round({c}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({c} AS DOUBLE), 6) END AS {c}" for c in names)
            ORACLES[name] = f"SELECT * REPLACE ({fixed}) FROM ({sql})" if names else sql
        return query

    return add


from .catalog import depth, execution, quotes, recordings, relational, research, stats  # noqa: E402, F401
