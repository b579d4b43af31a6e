"""Run the named queries and their SQL twins, and compare all rows.

python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        [[_plain(r[i]) for i in order] for r in rows], key=lambda r: [(v is None, str(type(v)), str(v)) for v in r]
    )


def compare(spark, con, query, sql, sf_dir) -> str:
    """An empty text when equal, else what differs."""
    df = query(spark, sf_dir)
    got_names, got = _canon(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _canon([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:3]} | {want[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    from tidemark.functions.session import get_session
    from tidemark.plans import QUERIES, SQL

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark = get_session(
        "oracle",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in SQL:
                problem = compare(spark, con, QUERIES[name], SQL[name], sf_dir)
            else:
                rows = QUERIES[name](spark, sf_dir).count()
                problem = "" if rows else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {'' if name in SQL else '(no SQL)'} {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
