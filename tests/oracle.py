"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    names, mine = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs_names, theirs = rows(theirs_names, result.fetchall())
    if names != theirs_names:
        return [f"columns {names} != {theirs_names}"]
    problems = []
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} != {len(theirs)}")
    for a, b in zip(mine, theirs):
        if a != b:
            problems.append(f"{a} != {b}")
            if len(problems) > 5:
                break
    kinds = {type(v).__name__ for r in mine for v in r}, {type(v).__name__ for r in theirs for v in r}
    if not problems and kinds[0] != kinds[1]:
        problems.append(f"types {kinds}")
    return problems
