"""Run queries and their SQL twins side by side.

    python tests/oracle.py [--sf 0.01] [key prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples, columns in name order, values with their kind."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None:
            return ("null", "")
        if isinstance(v, bool):
            return ("bool", str(v))
        if isinstance(v, float):
            return ("float", repr(v))
        if isinstance(v, int):
            return ("int", str(v))
        if hasattr(v, "isoformat"):
            return ("time", v.isoformat())
        return (type(v).__name__, str(v))

    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


SPARK_SECONDS: list[float] = []
SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def compare(spark, con, sf_dir, run, sql):
    """None when both sides agree, else a description of the difference."""
    start = time.time()
    df = run(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    SPARK_SECONDS.append(time.time() - start)
    if sql is None:
        return None if left[1] else "no rows"
    cursor = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    right = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    for name, kind in types.items():
        if SPARK_TO_SQL.get(kind, kind) != described[name]:
            return f"type of {name}: {kind} != {described[name]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    if not left[1]:
        return "no rows on either side"
    different = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if different:
        return f"{len(different)} of {len(left[1])} rows differ, first: {different[0]}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    from riskframe.plans.catalog import catalog

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = session(), duck(sf_dir)
    bad = 0
    for key, (run, sql) in catalog().items():
        if args.prefixes and not any(key.startswith(p) for p in args.prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, run, sql)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql " if sql else "rows"
        print(f"{key:36s} {kind} {time.time() - start:6.2f}s "
              f"(spark {SPARK_SECONDS[-1] if SPARK_SECONDS else 0:5.2f}s)  {problem or 'ok'}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
