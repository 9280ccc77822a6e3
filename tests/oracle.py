"""Compares a registered query with its SQL, run by DuckDB on the same parquet files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(type_name: str) -> str:
    t = type_name.lower()
    if t in ("bigint", "long", "int", "integer", "smallint", "tinyint", "hugeint", "uinteger", "ubigint"):
        return {"int": "integer", "long": "bigint"}.get(t, t)
    return {"varchar": "string", "float": "float"}.get(t, t)


def compare(df, con, sql: str) -> str | None:
    """None when rows, names and types agree, else what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    sql_types = {d[0]: kind(str(d[1])) for d in want.description}
    order = sorted(names)
    at = [names.index(n) for n in order]
    want_rows = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    got_rows = Counter(tuple(plain(v) for v in r) for r in df.select(*order).collect())
    if want_rows != got_rows:
        more = list((got_rows - want_rows).items())[:3]
        less = list((want_rows - got_rows).items())[:3]
        return (
            f"rows differ: {sum(got_rows.values())} here, {sum(want_rows.values())} in SQL; "
            f"only here {str(more)[:600]}; only SQL {str(less)[:600]}"
        )
    if not got_rows:
        return "no rows"
    wrong = {n: (spark_types[n], sql_types[n]) for n in names if spark_types[n] != sql_types[n]}
    return f"types differ: {wrong}" if wrong else None
