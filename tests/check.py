"""Compare registered queries by name: python -m tests.check SF name-part ..."""

from __future__ import annotations

import sys
import time

from roomfold.plans.catalog import ORACLES, QUERIES
from roomfold.session import build_session
from tests.compare import connection, difference, spark_rows, sql_rows


def main() -> None:
    sf_dir, parts = f"/root/testdata/sf{sys.argv[1]}", sys.argv[2:]
    spark = build_session("local[8]", 8, driver_memory="20g")
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sf_dir)
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            start = time.time()
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS {name} {len(got[1])} {took:.1f}s {got[1][:1]}", flush=True)
                continue
            start = time.time()
            want = sql_rows(con, ORACLES[name])
            diff = difference(got, want)
            print(f"{'FAIL' if diff else 'OK  '} {name} {len(got[1])} {took:.1f}s duck {time.time() - start:.1f}s {diff or ''}",
                  flush=True)
        except Exception as error:  # noqa: BLE001 - report every query
            print(f"ERR  {name} {type(error).__name__}: {' '.join(str(error).split())[:500]}", flush=True)


if __name__ == "__main__":
    main()
