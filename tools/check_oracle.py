"""Compare registered queries with their SQL form in DuckDB. Usage: check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from indicatrix import catalog  # noqa: E402
from indicatrix.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    names = sorted(df.columns)
    if names != sorted(theirs):
        return f"COLUMNS {sorted(set(names) ^ set(theirs))}"
    kinds = dict(df.dtypes)
    wrong = [(c, kinds[c], theirs[c]) for c in names if TYPES.get(kinds[c], kinds[c]) != theirs[c]]
    a = [tuple(row[c] for c in names) for row in df.collect()]
    position = [rel.columns.index(c) for c in names]
    b = [tuple(row[i] for i in position) for row in rel.fetchall()]
    if len(a) != len(b):
        return f"ROWS {len(a)} vs {len(b)}"

    def key(row):
        return tuple((v is None, type(v).__name__, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)

    def text_key(row):
        plain = tuple((v is None, str(v)) for v in row if not isinstance(v, float))
        return plain, tuple((v is None, v or 0.0) for v in row if v is None or isinstance(v, float))

    a.sort(key=text_key), b.sort(key=text_key)
    worst, exact = 0.0, 0
    bad = None
    for x, y in zip(a, b):
        for c, u, v in zip(names, x, y):
            if u == v:
                exact += 1
                continue
            if isinstance(u, float) and isinstance(v, float):
                if math.isnan(u) and math.isnan(v):
                    continue
                gap = abs(u - v) / max(1.0, abs(u))
                if gap > worst:
                    worst, bad = gap, (c, u, v)
                continue
            return f"VALUE {c}: {u!r} vs {v!r} in {x[:5]} / {y[:5]}"
    note = f"{len(a)} rows, max gap {worst:.1e}"
    if wrong:
        return f"TYPES {wrong}; {note}"
    return ("ok " if worst < 1e-9 else f"GAP {bad} ") + note


def main() -> None:
    sf, wanted = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sql = catalog.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    all_queries = catalog.queries()
    names = [n for n in all_queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    for name in names:
        started = time.time()
        try:
            df = all_queries[name](spark, sf_dir)
            result = compare(df, con, sql[name]) if name in sql else f"ok no SQL form, {len(df.collect())} rows"
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not result.startswith("ok")
        if wanted or not result.startswith("ok") or "no SQL" in result:
            print(f"{name}: {result} ({time.time() - started:.1f}s)", flush=True)
    print(f"{len(names) - failed} ok, {failed} failed; SQL without query: {sorted(set(sql) - set(all_queries))}")


if __name__ == "__main__":
    main()
