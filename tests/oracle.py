"""Hold a query against its SQL in DuckDB: columns by name, rows in any order."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, int):
        return str(v)
    return str(v) if not hasattr(v, "as_tuple") else repr(float(v))


def compare(spark, con, name, query, sql, sf_dir):
    """None where both agree, else what differs."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    kinds = dict(df.dtypes)
    show = lambda v, c: plain(float(v)) if v is not None and kinds[c] in ("double", "float") else plain(v)
    ours = sorted(tuple(show(r[c], c) for c in order) for r in df.collect())
    theirs = sorted(tuple(show(dict(zip(names, r, strict=True))[c], c) for c in order) for r in theirs)
    if ours != theirs:
        diff = next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), "lengths only")
        return f"{name}: {len(ours)} and {len(theirs)} rows, first difference {diff}"
    return None
