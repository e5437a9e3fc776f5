"""Registry of the queries exposed to the driver: name -> (spark callable, oracle SQL).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables of
that folder; its oracle is DuckDB SQL over the same base tables (fixture views inlined
as CTEs). Operators that SQL cannot state register without an oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: ``fn(t: Tables) -> DataFrame`` becomes ``queries()[name]``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = combine(with_views(*views), oracle)
        return fn

    return deco


def combine(prefix: str, sql: str) -> str:
    """Join a fixture ``WITH`` prefix and a query that may have its own ``WITH``."""
    body = sql.lstrip()
    if prefix and body[:5].upper() == "WITH ":
        return prefix.rstrip() + ",\n" + body[5:]
    return prefix + body


def load_all() -> None:
    """Import the catalog modules (each registers its queries on import)."""
    from pagemill.plans import catalog_pages, catalog_relational, catalog_scalars, catalog_content, catalog_jobs, catalog_lists  # noqa: F401
