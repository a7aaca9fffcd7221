"""Run registered queries against their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if v is None or isinstance(v, (bool, int, str)):
        return v
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: [(x is None, str(x)) for x in t])


def compare(spark, con, name: str, f, sql: str | None, d: str) -> str:
    df = f(spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got)}"
    rel = con.sql(sql)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    want = rows_of(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), (sorted(df.columns), sorted(rel.columns))
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "tinyint": "TINYINT", "smallint": "SMALLINT"}
    odd = [(c, t, kinds[c]) for c, t in df.dtypes if names.get(t, t) != kinds[c]]
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}; e.g. {list(set(got) ^ set(want))[:4]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, f"{len(bad)} rows differ in {sorted(df.columns)}: {bad[:2]}"
    assert not odd, f"types differ: {odd}"
    return f"{len(got)} rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from ludograph.session import get_session

    args = sys.argv[1:]
    d = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                                  "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(d), entry.queries(), entry.oracle_sql()
    failed = 0
    for name, f in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            print(f"ok   {name}: {compare(session, con, name, f, oracle.get(name), d)} {time.time() - t0:.1f}s", flush=True)
        except Exception as e:
            failed += 1
            text = str(e) if isinstance(e, AssertionError) else "".join(traceback.format_exception_only(e))
            print(f"FAIL {name}: {text[:900]}", flush=True)
    print("failed:", failed)
