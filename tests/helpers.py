"""Comparison of a Spark result with DuckDB's, whatever the order of rows and columns."""


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9) + 0.0)
    return str(x)


def same_rows(df, found):
    columns, rows = found
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [columns.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rows)
    assert ours == theirs
