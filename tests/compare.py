"""Compares a Spark result with a DuckDB result as multisets of typed values."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_FAMILY = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(df, con, sql):
    """Empty when names, types and rows agree; otherwise a list of findings."""
    found = []
    cursor = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    for name, kind in ours.items():
        if _FAMILY.get(kind, kind) != theirs[name]:
            found.append(f"type of {name}: {kind} != {theirs[name]}")
    names = sorted(ours)
    place = [d[0] for d in cursor.description]
    index = [place.index(n) for n in names]
    expected = Counter(tuple(r[i] for i in index) for r in cursor.fetchall())
    actual = Counter(tuple(r[n] for n in names) for r in df.collect())
    if actual != expected:
        more, less = actual - expected, expected - actual
        found.append(
            f"rows {sum(actual.values())} != {sum(expected.values())}; only ours "
            f"{list(more)[:2]}; only theirs {list(less)[:2]}"
        )
    elif not actual:
        found.append("both results are empty")
    return found
