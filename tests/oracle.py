"""Run a query on Spark and its SQL on DuckDB and compare names, types, counts and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# Spark type -> DuckDB types that hold the same values
SAME_TYPE = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "float": {"FLOAT"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return None if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_normal(row[i]) for i in order) for row in rows), key=lambda t: tuple(str(x) for x in t))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    relation = con.sql(sql)
    kinds = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if set(df.columns) != set(kinds):
        return f"columns {sorted(df.columns)} against {sorted(kinds)}"
    for name, kind in df.dtypes:
        if kinds[name] not in SAME_TYPE.get(kind, set()):
            return f"type of {name}: {kind} against {kinds[name]}"
    expected = _rows(list(kinds), con.execute(sql).fetchall())
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(found)} rows differ, first {wrong[0][0]} against {wrong[0][1]}"
    return None


def main(argv):
    import traceback

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = argv[0]
    names = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            result = compare(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as error:
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            if "-v" in names:
                traceback.print_exc()
        ok = result is None
        bad += not ok and not result.startswith("no SQL")
        print(f"{'ok ' if ok else '-- '} {time.time() - start:6.1f}s {name}{'' if ok else ': ' + result}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main(sys.argv[1:])
