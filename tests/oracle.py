"""Run registered queries on both engines and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    left_names, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    result = con.execute(sql)
    right_names, right = _rows([d[0] for d in result.description], result.fetchall())
    note = f"{len(left)} rows, {took:.1f}s"
    if left_names != right_names:
        return False, f"columns {left_names} != {right_names}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3] if len(left) < 200_000 else []
        only_right = [r for r in right if r not in set(left)][:3] if len(right) < 200_000 else []
        return False, f"{len(left)} vs {len(right)} rows\n  spark {only_left}\n  duck  {only_right}"
    return True, note


def main(argv: list[str]) -> int:
    """python tests/oracle.py [sf] [name fragment ...]"""
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from auditspark.session import local_session
    spark = local_session("8")
    sf_dir = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    con, failed = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, query, oracles[name])
            else:
                start = time.time()
                ok, note = True, f"{query(spark, sf_dir).count()} rows, {time.time() - start:.1f}s, no oracle"
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL "), name, note, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
