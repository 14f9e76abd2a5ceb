"""Compare ``queries()`` against ``oracle_sql()`` the way the driver does.

Row count, column names, and an order-insensitive hash of the rows with
columns sorted by name. Used by the test-suite and runnable by hand:

    python tests/oracle_check.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9)) if v != 0 else "0.0"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def spark_rows(df):
    rows = [tuple(r) for r in df.collect()]
    return list(df.columns), rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    s_cols, s_rows = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    res = {"key": name, "spark_sec": round(t1 - t0, 2), "spark_rows": len(s_rows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d_cols, d_rows = duck_rows(con, sql)
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return res
    sn, sh = digest(s_cols, s_rows)
    dn, dh = digest(d_cols, d_rows)
    res["status"] = "match" if (sn == dn and sh == dh) else ("ROWCOUNT" if sn != dn else "VALUES")
    if res["status"] == "VALUES":
        order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        dorder = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        sset = {repr(tuple(_norm(r[i]) for i in order)) for r in s_rows}
        dset = {repr(tuple(_norm(r[i]) for i in dorder)) for r in d_rows}
        res["spark_only"] = sorted(sset - dset)[:2]
        res["oracle_only"] = sorted(dset - sset)[:2]
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from vectorloom.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or list(queries())
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for k in keys:
        try:
            r = compare(spark, con, sf_dir, k, qs[k], os_.get(k))
        except Exception as exc:  # report and continue
            r = {"key": k, "status": f"ERROR {type(exc).__name__}: {str(exc)[:300]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
