"""Compare a Spark query with its SQL in DuckDB, as sorted rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(spark_df, db, sql):
    """Empty string if equal, else what differs."""
    names, rows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    cursor = db.execute(sql)
    other_names = [c[0] for c in cursor.description]
    other = cursor.fetchall()
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} != {sorted(other_names)}"
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)}"
    if not rows:
        return "empty result"
    for mine, theirs in zip(rows_of(names, rows), rows_of(other_names, other)):
        if not all(map(same, mine, theirs)):
            return f"{sorted(names)}: {mine} != {theirs}"
    return ""
