"""All queries of the library proper: name to callable of (spark, sf_dir), and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that states its rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from auditlake.plans import audit, comparisons, evaluation, fidelity, noise, preparation, structure, summaries  # noqa: E402, F401
