"""What several test modules share; a plain module, so that no folder's conftest stands in its way."""


def rows(df, *columns):
    """Rows as plain tuples, sorted by their text."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=str)


def final_plan(df) -> str:
    """The physical plan after adaptive execution has run it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
