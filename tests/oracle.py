"""Run a registered query in Spark and its SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.9g}")
    return (1, str(value))


def compare(con, df, sql: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when the results agree."""
    relation = con.execute(sql)
    theirs_types = {d[0]: str(d[1]) for d in relation.description}
    rows = relation.fetchall()
    names = sorted(theirs_types)
    order = [d[0] for d in relation.description]
    problems = []
    ours_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if sorted(ours_types) != names:
        return [f"columns {sorted(ours_types)} / {names}"]
    for name in names:
        if ours_types[name] != theirs_types[name]:
            problems.append(f"type of {name}: {ours_types[name]} / {theirs_types[name]}")
    ours = sorted(tuple(_cell(row[name]) for name in names) for row in df.collect())
    theirs = sorted(tuple(_cell(row[order.index(name)]) for name in names) for row in rows)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} / {len(theirs)}")
    if ours != theirs:
        a, b = set(ours), set(theirs)
        problems.append(f"only ours {len(a - b)}, e.g. {sorted(a - b)[:2]}"[:900])
        problems.append(f"only theirs {len(b - a)}, e.g. {sorted(b - a)[:2]}"[:900])
    if not rows:
        problems.append("no rows at all")
    return problems
