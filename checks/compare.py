"""Run queries against their oracles: ``python -m checks.compare [sf dir] [name prefix ...]``."""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

from . import ORACLES, QUERIES
from .base import TABLES


def session(cores: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("vacatlas-check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


_ALIAS = {"bigint": "long", "integer": "int", "varchar": "string", "tinyint": "int", "timestamp": "timestamp",
          "timestamp with time zone": "timestamp", "smallint": "int"}


def check(spark, con, sf: str, name: str) -> tuple[str, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf)
    got = df.collect()
    spent = f"{time.time() - t0:.1f}s"
    if name not in ORACLES:
        return "rows", f"{len(got)} rows {spent}"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    types = [f"{f.name}:{f.dataType.simpleString()}/{kinds[f.name]}" for f in df.schema
             if _ALIAS.get(kinds[f.name], kinds[f.name]) not in
             (f.dataType.simpleString(), {"bigint": "long"}.get(f.dataType.simpleString()))]
    note = f" types {types}" if types else ""
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return "FAIL", (f"{len(a)} vs {len(b)} rows; spark only {sorted(sa - sb)[:2]} "
                        f"oracle only {sorted(sb - sa)[:2]}{note}")
    return "ok" if a else "EMPTY", f"{len(a)} rows {spent}{note}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con, bad = session(), connect(sf), 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            state, note = check(spark, con, sf, name)
        except Exception as e:  # report and go on with the next query
            state, note = "ERROR", str(e)[:600]
        bad += state in ("FAIL", "ERROR")
        print(f"{state:6} {name}: {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
