"""Runs registered queries and their SQL twins side by side: python -m tests.parity SF NAME..."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.9g}")
    return v


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def compare(df, sf_dir: str, sql: str) -> str:
    """An empty string, or how they differ."""
    names, want = oracle(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(rows_of(df.columns, got), rows_of(names, want), strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, sql, bad = f"/root/testdata/{args[0]}", entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(args) > 1 and not any(a in name for a in args[1:]) or f"-{name}" in args:
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            said = compare(df, sf_dir, sql[name]) if name in sql else f"(no SQL) {df.count()} rows"
        except Exception as e:  # the next query is still run
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'same'} [{time.time() - began:.1f} s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
