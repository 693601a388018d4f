"""Queries of the training-data operators: name -> callable, and their DuckDB SQL."""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that files a query under ``name`` with its SQL twin."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


from chronoloom.llm.queries import numeric, texts  # noqa: E402,F401
