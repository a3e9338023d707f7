"""Spark-vs-DuckDB comparison of registered queries (same rules as the driver).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from larder.sources.tables import TABLES  # noqa: E402


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return out


def _key(row):
    return tuple((0, "") if v is None else (1, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def _close(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
        except (TypeError, ValueError):
            return False
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    sc, dc = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count spark={len(spark_pdf)} duck={len(duck_pdf)}"
    a = sorted(_rows(spark_pdf), key=_key)
    b = sorted(_rows(duck_pdf), key=_key)
    exact = True
    for ra, rb in zip(a, b):
        if not all(_close(x, y) for x, y in zip(ra, rb)):
            return False, f"value mismatch: spark={ra} duck={rb}"
        if ra != rb:
            exact = False
    return True, "ok" if exact else "ok (float ulp)"


def check(spark, sf_dir: str, names=None, verbose=True) -> dict[str, str]:
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    res = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(f"{name:36s} {res[name]}", flush=True)
            continue
        t1 = time.time()
        if name not in orc:
            res[name] = f"rows-only ({len(sp)} rows)"
        else:
            try:
                dk = con.execute(orc[name]).df()
                ok, msg = compare(sp, dk)
                res[name] = ("PASS " if ok else "FAIL ") + msg + f" [{len(sp)} rows]"
            except Exception as e:  # noqa: BLE001
                res[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:300]}"
        if verbose:
            print(f"{name:36s} {t1 - t0:6.2f}s  {res[name]}", flush=True)
    return res


if __name__ == "__main__":
    from larder.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    r = check(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in r.items() if not (v.startswith("PASS") or v.startswith("rows-only"))}
    print(f"\n{len(r) - len(bad)}/{len(r)} ok; failing: {sorted(bad)}")
