"""Compare a query's rows with its SQL's, as sets of normalised rows."""

from collections import Counter

import duckdb


def connect(folder):
    import os

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return None if v is None or str(v) == "NaT" else v


def counted(frame):
    frame = frame[sorted(frame.columns)]
    return Counter(repr([norm(x) for x in r]) for r in frame.itertuples(index=False, name=None))


def differences(spark_rows, sql_rows):
    assert sorted(spark_rows.columns) == sorted(sql_rows.columns)
    a, b = counted(spark_rows), counted(sql_rows)
    return list((a - b).items())[:3], list((b - a).items())[:3]
