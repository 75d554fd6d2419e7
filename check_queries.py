"""Compare registered queries with their SQL counterparts: python check_queries.py [sf_dir] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

from tallystar.queries import REGISTRY
from tallystar.session import build_session


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, sf_dir):
    query = REGISTRY[name]
    started = time.time()
    frame = query.build(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - started
    if not query.oracle:
        return f"rows {len(got[1])}", seconds, got[1][:1]
    cursor = con.execute(query.oracle)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        mine = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
        odd = [f"{c}:{mine[c]}/{kinds[c]}" for c in mine if not _same_kind(mine[c], kinds[c])]
        return f"same {len(got[1])}" + (f" TYPES {odd}" if odd else ""), seconds, None
    detail = [] if got[0] == want[0] else [("columns", got[0], want[0])]
    detail += [(len(got[1]), len(want[1])), *[p for p in zip(got[1], want[1]) if p[0] != p[1]][:2]]
    return "DIFFERENT", seconds, detail


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "smallint": "SMALLINT"}


def _same_kind(mine, theirs):
    return _KINDS.get(mine) in (theirs, None)


def main(args):
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    failed = 0
    for name in args[1:] or REGISTRY:
        try:
            verdict, seconds, detail = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep going through the list
            verdict, seconds, detail = "ERROR", 0.0, str(error)[:1500]
        failed += verdict in ("DIFFERENT", "ERROR")
        print(f"{name:24} {seconds:6.2f}s {verdict}" + (f"\n    {detail}" if detail and not verdict.startswith("rows") else ""), flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
