"""Runs queries next to their SQL: ``python tests/check_queries.py <folder> [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql):
    """Text that tells the first difference, or None when both answers are the same."""
    columns, got = by_name(df.columns, [tuple(r) for r in df.collect()])
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    wanted_columns, wanted = by_name(names, told.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, SQL has {len(wanted)}"
    wrong = [(a, b) for a, b in zip(got, wanted) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(wrong)} of {len(got)} rows, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from keyrhythm.catalog import QUERIES, SQL
    from keyrhythm.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            verdict = differences(df, con, SQL[name]) if name in SQL else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{name:24s} {time.time() - start:6.2f}s  {'ok' if verdict is None else verdict}", flush=True)
