"""Compare registered queries with their SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(normal(row[k]) for k in at) for row in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v) for v in t)), [names[k] for k in at]


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return f"rows-only {len(rows)} rows {seconds:.1f}s", True
    got, cols = ordered(df.columns, rows)
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, wcols = ordered(names, cur.fetchall())
    oracle = time.time() - started
    if cols != wcols:
        return f"COLUMNS {cols} vs {wcols}", False
    types = [{type(v) for v in c if v is not None} for c in zip(*got)]
    wtypes = [{type(v) for v in c if v is not None} for c in zip(*want)]
    if types != wtypes and len(got) and len(want):
        return f"TYPES {list(zip(cols, types, wtypes))}", False
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"DIFF {len(got)} vs {len(want)} rows {cols} {diff}", False
    return f"ok {len(got)} rows spark {seconds:.1f}s duckdb {oracle:.1f}s", True


def main(argv):
    import duckdb

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if argv[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv[1:]):
            continue
        try:
            message, good = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            message, good = f"ERROR {type(error).__name__} {str(error)[:700]}", False
        print(f"{'  ' if good else '!!'} {name}: {message}", flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
