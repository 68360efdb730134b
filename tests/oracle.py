"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os


def rows_of(cells, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(x, 6)) if isinstance(x, float) else repr(x)

    return sorted(tuple(value(r[i]) for i in order) for r in cells), [columns[i] for i in order]


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        source = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
        c.execute(f"create view {name} as select * from '{source}'")
    return c


def compare(df, connection, sql):
    mine, my_columns = rows_of([tuple(r) for r in df.collect()], df.columns)
    cursor = connection.execute(sql)
    theirs, their_columns = rows_of(cursor.fetchall(), [d[0] for d in cursor.description])
    assert my_columns == their_columns
    assert mine == theirs
    return len(mine)
