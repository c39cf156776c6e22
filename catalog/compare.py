"""Run a registered query and its SQL twin and compare the results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if (Path(sf_dir) / f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    """One spelling per value; types must already agree, except int width."""
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    if isinstance(value, Decimal):
        return ("decimal", str(value.normalize()))
    return (type(value).__name__, str(value))


def _bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """'ok (n rows)' or what differs."""
    df = query(spark, sf_dir)
    ours = _bag(df.collect(), df.columns)
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    theirs = _bag(result.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if ours == theirs:
        return f"ok ({sum(ours.values())} rows)"
    left, right = list((ours - theirs).items()), list((theirs - ours).items())
    return (
        f"values differ: {sum(ours.values())} / {sum(theirs.values())} rows, {len(left)} only here, "
        f"{len(right)} only in SQL\n   {sorted(df.columns)}\n   here {sorted(left, key=str)[:2]}\n   sql  {sorted(right, key=str)[:2]}"
    )


def main(argv: list[str]) -> int:
    from catalog import all_queries, all_sql
    from laborloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql, bad = all_sql(), 0
    for name, query in all_queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        began = time.time()
        try:
            if name in sql:
                verdict = compare(spark, con, sf_dir, query, sql[name])
            else:
                verdict = f"ok ({query(spark, sf_dir).count()} rows, no SQL)"
        except Exception as error:  # report every query, not only the first failure
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not verdict.startswith("ok")
        print(f"{name:42s} {time.time() - began:6.1f}s  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
