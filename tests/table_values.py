from __future__ import annotations


def values(df, *columns):
    """Rows as sorted tuples."""
    rows = [tuple(row) for row in (df.select(*columns) if columns else df).collect()]
    return sorted(rows, key=repr)
