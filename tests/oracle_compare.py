"""Run a registered query on Spark and its oracle SQL on DuckDB; compare.

Mirrors the driver's check: row count, column names, and an
order-insensitive comparison of values (doubles compared after rounding).
Usable as a script: ``python tests/oracle_compare.py [sf_dir] [names...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


# Type families, so the check is on what the driver's schema match sees.
_SPARK_T = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
            "double": "double", "float": "float", "string": "string", "boolean": "bool",
            "date": "date", "timestamp": "timestamp"}
_DUCK_T = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8",
           "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "bool",
           "DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp"}


def _family(t: str, table: dict) -> str:
    if t.lower().startswith("decimal"):
        return t.lower().replace(" ", "")
    return table.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, (str(t) for t in rel.types)))
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    else:
        for f in sdf.schema.fields:
            a = _family(f.dataType.simpleString(), _SPARK_T)
            b = _family(d_types[f.name], _DUCK_T)
            if a != b:
                problems.append(f"type of {f.name}: spark {f.dataType.simpleString()} "
                                f"duck {d_types[f.name]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif not problems:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problems.append(f"{len(bad)} value mismatches, e.g. {bad[:3]}")
    return problems, t1 - t0, len(s_rows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from tessera.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in oracle:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            problems, secs, n = compare(spark, con, name, fn, oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, secs, n = [f"error {type(e).__name__}: {str(e)[:400]}"], 0, 0
        status = "OK   " if not problems else "FAIL "
        failed += bool(problems)
        print(f"{status} {name}: {n} rows ({secs:.1f}s) {'; '.join(problems)}")
    print(f"failed={failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
