"""Compare a Spark result with the result of SQL in DuckDB, regardless of row order."""

import glob
import os

import duckdb


def duck_rows(sql: str, folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, folder: str) -> str | None:
    """None when both sides agree, else what differs."""
    names, rows = duck_rows(sql, folder)
    mine = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    left, right = sorted_rows(df.columns, mine), sorted_rows(names, rows)
    if left == right:
        return None
    extra = [x for x in left if x not in set(right)][:2] if len(left) < 5000 else []
    missing = [x for x in right if x not in set(left)][:2] if len(left) < 5000 else []
    first = next(((a, b) for a, b in zip(left, right) if a != b), None)
    return f"{len(left)} and {len(right)} rows; {extra} / {missing}; {first}"
