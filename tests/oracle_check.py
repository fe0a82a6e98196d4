"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares column names, row count and the multiset of rows (floats compared
after rounding to 9 significant digits).
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, float(f"{v:.9g}"))
    if hasattr(v, "item"):
        v = v.item()
        return _norm(v)
    if hasattr(v, "isoformat"):
        return (2, v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat())
    if isinstance(v, bool):
        return (3, int(v))
    if isinstance(v, int):
        return (1, float(v))
    return (4, str(v))


def rows_of(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    rel = con.sql(sql)
    ocols = rel.columns
    orows = rel.fetchall()
    ok_cols = sorted(scols) == sorted(ocols)
    ok_n = len(srows) == len(orows)
    ok_v = ok_cols and rows_of(srows, scols) == rows_of(orows, ocols)
    stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
    otypes = [str(t) for t in rel.types]
    return dict(name=name, cols=ok_cols, rows=ok_n, values=ok_v, n_spark=len(srows), n_oracle=len(orows),
                sec=round(t1 - t0, 2), scols=list(zip(scols, stypes)), ocols=list(zip(ocols, otypes)),
                sample_s=srows[:3], sample_o=orows[:3])


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from ratewise.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in os_:
            df = qs[name](spark, sf_dir)
            print(f"[rows-only] {name}: {df.count()} rows")
            continue
        try:
            r = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # report and go on
            bad += 1
            print("ERR ", name, str(e).splitlines()[0][:300])
            continue
        good = r["cols"] and r["rows"] and r["values"]
        bad += not good
        print(("OK  " if good else "FAIL"), name, r["n_spark"], r["n_oracle"], f"{r['sec']}s")
        if not good:
            print("   spark :", r["scols"]); print("   oracle:", r["ocols"])
            print("   s:", r["sample_s"]); print("   o:", r["sample_o"])
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
