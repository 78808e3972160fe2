"""Run queries next to their SQL on the parquet tables and compare the results."""

from __future__ import annotations

import glob
import os
import sys
import time

import pandas as pd

from workload import load


def normalise(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        rows.append(tuple(
            None if v is None or (isinstance(v, float) and v != v)
            else repr(float(v)) if isinstance(v, float) else str(v)
            for v in row
        ))
    return sorted(rows, key=str)


def compare(spark, sf_dir: str, names=None) -> dict[str, str]:
    import duckdb

    queries, oracles = load()
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    out = {}
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            spent = time.time() - t0
            if name not in oracles:
                out[name] = f"rows {len(got)} {spent:.1f}s"
            else:
                t1 = time.time()
                want = con.execute(oracles[name]).df()
                sql = time.time() - t1
                a, b = normalise(got), normalise(want)
                if sorted(got.columns) != sorted(want.columns):
                    out[name] = f"FAIL columns {list(got.columns)} {list(want.columns)}"
                elif a != b:
                    diff = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
                    out[name] = f"FAIL {len(a)} {len(b)} {diff}"
                else:
                    out[name] = f"ok {len(a)} rows {spent:.1f}s sql {sql:.1f}s"
        except Exception as exc:  # noqa: BLE001
            out[name] = "FAIL " + str(exc)[:700]
        print(f"{name}: {out[name]}", flush=True)
    return out


if __name__ == "__main__":
    from workload import local_session

    session = local_session()
    result = compare(session, sys.argv[1], set(sys.argv[2:]))
    failed = [n for n, r in result.items() if r.startswith("FAIL")]
    print(f"{len(result)} queries, failed: {failed}")
