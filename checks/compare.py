"""Run registered queries on Spark and their SQL on DuckDB, and compare.

usage: python -m checks.compare [folder] [name prefix ...]
"""

from __future__ import annotations

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty text when names and values agree, else what differs."""
    got_names, got = list(spark_df.columns), [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns differ: {set(got_names) ^ set(want_names)}"
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}"
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    names = sorted(got_names)
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if not bad:
        return ""
    x, y = bad[0]
    cells = [(n, p, q) for n, p, q in zip(names, x, y) if p != q or type(p) is not type(q)]
    return f"{len(bad)} rows differ, first: {cells[:4]}"


def main() -> int:
    from checks.oracle import oracle_sql
    from souk.registry import QUERIES, run
    from souk.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, con, oracle = local_session(8), connect(folder), oracle_sql()
    failed = 0
    for name in QUERIES:
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(name, spark, folder)
            note = compare(df, con, oracle[name]) if name in oracle else f"no sql, {df.count()} rows"
        except Exception as error:  # report and go on with the other queries
            note = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        failed += bool(note) and not note.startswith("no sql")
        took = time.time() - start
        if note or took > 3:
            print(f"{name}: {note or 'ok'} ({took:.1f}s)", flush=True)
    print(f"failed: {failed} of {len(QUERIES)}; without sql: {sorted(set(QUERIES) - set(oracle))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
