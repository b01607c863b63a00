"""Compare registered queries with their oracle SQL: columns, types, rows and values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

SPARK_KIND = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float",
    "float": "float", "string": "text", "boolean": "bool",
}
DUCK_KIND = {
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return round(float(value), 6) + 0.0


def compare(spark, con, name, query, oracle, sf_dir) -> str | None:
    """Reason of a mismatch, or None."""
    df = query(spark, sf_dir)
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cursor = con.execute(oracle)
    theirs = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(mine) != sorted(theirs):
        return f"columns {sorted(mine)} != {sorted(theirs)}"
    kinds = {
        n: (SPARK_KIND.get(mine[n], mine[n]), DUCK_KIND.get(theirs[n], theirs[n]))
        for n in mine
        if SPARK_KIND.get(mine[n], mine[n]) != DUCK_KIND.get(theirs[n], theirs[n])
    }
    if kinds:
        return f"types {kinds}"
    cols = sorted(mine)
    at = [list(theirs).index(c) for c in cols]
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else "") for v in row)
    left = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=key)
    right = sorted((tuple(_norm(r[i]) for i in at) for r in cursor.fetchall()), key=key)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; spark {left[:1]} duck {right[:1]}"
    for a, b in zip(left, right):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6) for x, y in zip(a, b)
        ):
            return f"values {dict(zip(cols, a))} != {dict(zip(cols, b))}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from corredor.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in wanted:
        start = time.time()
        if os.environ.get("TRACE"):
            print("run", name, flush=True)
        try:
            if name in oracle:
                problem = compare(spark, con, name, queries[name], oracle[name], sf_dir)
            else:
                problem = None
                rows = queries[name](spark, sf_dir).count()
                print(f"  rows-only {name}: {rows}")
        except Exception as error:  # noqa: BLE001 - the check reports every failure
            problem = f"error {type(error).__name__} {str(error)[:700]}"
        took = time.time() - start
        if problem:
            bad += 1
            print(f"FAIL {name} ({took:.1f}s) {problem}")
        elif took > 6:
            print(f"slow {name} ({took:.1f}s)")
    print(f"{len(wanted) - bad}/{len(wanted)} match")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
