"""Names of the queries over the driver's tables, with the DuckDB SQL that each must equal."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under name."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


from factloom.plans import fact_queries, index_queries, text_queries  # noqa: E402, F401  register their queries
