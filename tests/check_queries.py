"""Run registered queries and compare them with their SQL in DuckDB.

    python tests/check_queries.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    names, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    other, right = rows_of(rel.columns, rel.fetchall())
    if names != other:
        return f"columns {names} vs {other}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; only spark {list(set(left) - set(right))[:2]} only sql {list(set(right) - set(left))[:2]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} vs {b}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from cellscape.session import local_session

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    spark, con = local_session(8), connect(sf)
    oracle, bad = oracle_sql(), 0
    for name, run in queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                n = "" if problem else "ok"
            else:
                n, problem = f"rows {df.count()}", None
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            n, problem = "", f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
