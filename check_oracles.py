"""Run registered queries beside their SQL oracles and report differences.

    python check_oracles.py [--sf 0.01] [--exact] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from ledgerlife.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


DIGITS = 9  # significant digits compared; --exact compares doubles bit for bit


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.{DIGITS}g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.{DIGITS}g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Differences between a Spark result and an oracle; empty text when equal."""
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    oracle_columns, oracle_rows = rows_of(names, found.fetchall())
    compare.rows = len(spark_rows)
    if spark_columns != oracle_columns:
        return f"columns {spark_columns} != {oracle_columns}"
    if len(spark_rows) != len(oracle_rows):
        return f"rows {len(spark_rows)} != {len(oracle_rows)}"
    different = [(a, b) for a, b in zip(spark_rows, oracle_rows) if a != b]
    if different:
        return f"{len(different)} rows differ, first {spark_columns}\n   spark  {different[0][0]}\n   oracle {different[0][1]}"
    types = dict(df.dtypes)
    wide = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date", "VARCHAR": "string", "BOOLEAN": "boolean"}
    odd = [
        f"{d[0]}: {types[d[0]]} / {d[1]}"
        for d in found.description
        if wide.get(str(d[1])) != types[d[0]] and not str(d[1]).endswith("[]")
    ]
    return "types " + ", ".join(odd) if odd else ""


compare.rows = 0


def main() -> int:
    from ledgerlife.plans import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--exact", action="store_true")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    if options.exact:
        global DIGITS
        DIGITS = 17
    folder = f"/root/testdata/sf{options.sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in options.names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                kind = "oracle"
            else:
                compare.rows = len(df.collect())
                problem, kind = "", "rows"
        except Exception as error:  # report and go on with the next query
            problem, kind = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        bad += bool(problem)
        shown = f"{compare.rows} rows" if kind != "error" else ""
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - started:.1f}s {shown} {problem}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
