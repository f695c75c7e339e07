"""Run registered queries next to their check SQL and compare whole results.

Usage: python tests/compare.py [name-prefix ...]   (env CHECK_SF_DIR)
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.plans.registry import TABLES  # noqa: E402


def oracle(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


STRICT = bool(os.environ.get("STRICT"))


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        if not STRICT:
            value = round(float(f"{value:.10g}"), 7)
        return int(value) if value == int(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, norm(v)) for k, v in sorted(value.items()))
    return value


KINDS = {"int8": "int", "int16": "int", "int32": "int", "int64": "int", "double": "float", "float": "float"}


def kind(arrow_type) -> str:
    text = str(arrow_type)
    if text.startswith("timestamp"):
        return "timestamp"
    if text.startswith("list<"):
        return "list<" + text.split(": ", 1)[1]
    if text.startswith("decimal"):
        return text
    if text == "large_string":
        return "string"
    return text if STRICT else KINDS.get(text, text)


def compare(spark_table, duck_table) -> list[str]:
    problems = []
    a, b = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if a != b:
        return [f"columns differ: spark {a} sql {b}"]
    for c in a:
        ka, kb = kind(spark_table.schema.field(c).type), kind(duck_table.schema.field(c).type)
        if ka != kb:
            problems.append(f"type of {c}: spark {ka} sql {kb}")
    left = Counter(tuple(norm(r[c]) for c in a) for r in spark_table.to_pylist())
    right = Counter(tuple(norm(r[c]) for c in a) for r in duck_table.to_pylist())
    if left != right:
        problems.append(f"rows: spark {sum(left.values())} sql {sum(right.values())}")
        problems.append(f"columns {a}")
        problems.append(f"only spark: {[str(x)[:300] for x in list((left - right))[:3]]}")
        problems.append(f"only sql:   {[str(x)[:300] for x in list((right - left))[:3]]}")
    elif not left:
        problems.append("EMPTY result on both sides")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import bench_master, clean_up, get_spark

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark(
        master=bench_master(),
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = oracle(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            table = fn(spark, folder).toArrow()
            took = time.time() - start
            if name not in sqls:
                note = "rows-only" if table.num_rows else "rows-only EMPTY"
                print(f"--   {name} {table.num_rows} rows {took:.1f}s {note}", flush=True)
                continue
            t1 = time.time()
            duck = con.execute(sqls[name]).to_arrow_table()
            problems = compare(table, duck)
            slow = f" SQL {time.time() - t1:.1f}s" if time.time() - t1 > 5 else ""
        except Exception as err:  # noqa: BLE001
            problems, took, table, slow = [str(err)[:900]], time.time() - start, None, ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        clean_up(spark)
        if problems:
            bad += 1
            print(f"BAD  {name} {took:.1f}s{slow}", flush=True)
            for p in problems:
                print("       ", p, flush=True)
        else:
            print(f"ok   {name} {table.num_rows} rows {took:.1f}s{slow}", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
