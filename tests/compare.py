"""Run registered queries against their SQL on DuckDB. ``python -m tests.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool", "timestamp": "ts", "date": "date"}
DUCK = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date"}


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    columns = sorted(df.columns)
    rows = Counter(tuple(canonical(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != columns:
        return False, f"columns {columns} vs {sorted(names)}", sum(rows.values())
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(canonical(r[i]) for i in order) for r in rel.fetchall())
    types = {c: str(t) for c, t in zip(names, rel.types)}
    note = []
    for f in df.schema.fields:
        a, b = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()), DUCK.get(types[f.name], types[f.name])
        if a != b:
            note.append(f"type {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
    if rows != expected:
        only_a, only_b = list((rows - expected).items())[:3], list((expected - rows).items())[:3]
        return False, f"rows {sum(rows.values())} vs {sum(expected.values())}; spark only {only_a}; sql only {only_b}; {note}", sum(rows.values())
    return not note, "; ".join(note), sum(rows.values())


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import spark_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = spark_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if args[1:] and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, note, n = compare(df, con, oracles[name])
            else:
                n = df.count()
                ok, note = True, "no sql"
        except Exception as e:  # noqa: BLE001
            ok, note, n = False, f"{type(e).__name__}: {str(e)[:700]}", 0
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
        spark.catalog.clearCache()
    print(f"failed: {bad}")


if __name__ == "__main__":
    main()
