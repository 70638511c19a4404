"""Compare registered queries with DuckDB: python tests/oracle.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    if d in {"bigint", "long", "int", "integer", "smallint", "tinyint", "hugeint"}:
        return "int" if d != "hugeint" else "hugeint"
    return {"varchar": "string", "float": "double"}.get(d, d)


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, float):
            if math.isnan(v):
                return (0, "")
            return (2, f"{v + 0.0:.9g}" if v else "0")
        return (3, str(v))
    return sorted(tuple(cell(v) for v in r) for r in rows)


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{name}: {len(got)} rows in {took:.1f}s (no SQL)"
    start = time.time()
    rel = con.sql(sql)
    cols = list(rel.columns)
    if sorted(cols) != names:
        return False, f"{name}: columns {names} against {sorted(cols)}"
    theirs = {c: kind(str(t)) for c, t in zip(cols, rel.types)}
    ours = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    if ours != theirs:
        return False, f"{name}: types {[(c, ours[c], theirs[c]) for c in names if ours[c] != theirs[c]]}"
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({sql})").fetchall()
    a, b = canonical(got), canonical(want)
    extra = f"{name}: {len(a)} rows in {took:.1f}s, DuckDB {time.time() - start:.1f}s"
    if len(a) != len(b):
        return False, f"{extra}: {len(b)} rows expected"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{extra}: {len(bad)} rows differ {names}\n   ours   {bad[0][0]}\n   theirs {bad[0][1]}"
    return True, extra


def main(args: list[str]) -> int:
    import __spark_entry__ as entry
    from shootlake.session import build_session
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = args[1:]
    failed = 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # a broken query must not hide the others
            ok, note = False, f"{name}: {type(e).__name__} {str(e)[:900]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + note, flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
