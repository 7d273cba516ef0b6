"""Where queries register: name -> callable(spark, directory), and name -> DuckDB SQL."""

from __future__ import annotations

from kithgraph.plans import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(select: str | None, *stages: dict[str, str]):
    """Registers a query under its function's name, with its SQL."""

    def register(run):
        QUERIES[run.__name__] = run
        if select:
            ORACLE_SQL[run.__name__] = sql.query(select, *stages)
        return run

    return register
