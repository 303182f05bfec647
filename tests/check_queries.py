"""Command line: python tests/check_queries.py [sf] [name ...] — compare queries with their check SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from spectraloom.session import build_session  # noqa: E402
from tests import compare as C  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql = E.queries(), E.oracle_sql()
    con = C.duck(C.sf_dir(sf))
    failed = 0
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            got = C.spark_rows(fn(spark, C.sf_dir(sf)))
            took = time.time() - start
            if name in sql:
                diff = C.differences(got, C.duck_rows(con, sql[name]))
                state = "ok" if not diff else "DIFF " + diff[:1500]
            else:
                state = "rows only"
            print(f"{name:42s} {took:6.2f}s {len(got[1]):6d} rows  {state}", flush=True)
            failed += state.startswith("DIFF")
        except Exception as exc:  # report and go on
            failed += 1
            print(f"{name:42s} ERROR {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("failed", failed)
    sys.exit(1 if failed else 0)
