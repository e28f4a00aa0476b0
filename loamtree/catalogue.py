"""Where queries and their SQL are registered."""

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame by its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
