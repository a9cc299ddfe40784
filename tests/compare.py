"""Run registered queries in Spark and DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return False, f"columns {names} vs {want_names}"
    if got != want:
        only_spark, only_sql = got - want, want - got
        return False, (f"rows {sum(got.values())} vs {sum(want.values())}; spark only {sum(only_spark.values())} "
                       f"{list(only_spark)[:2]}; sql only {sum(only_sql.values())} {list(only_sql)[:2]}")
    return True, f"{sum(got.values())} rows"


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import oracle_sql, queries
    from attestra.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    sqls = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                ok, note = compare(spark, con, fn, sqls[name], sf)
            else:
                ok, note = True, f"no oracle, {fn(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            ok, note = False, str(e).replace("\n", " ")[:600]
        bad += not ok
        empty = " EMPTY" if note == "0 rows" or note.endswith(", 0 rows") else ""
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note[:900]}{empty}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
