"""Rows of Spark against rows of DuckDB."""


def same_rows(df, sql, duck):
    """Spark's and DuckDB's rows, whatever their order."""
    got, want = df.toPandas(), duck.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda x: sorted((tuple(r) for r in x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=repr)
    assert rows(got) == rows(want)
