"""python tests/run_compare.py [folder] [key ...]: compare queries with their oracles."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from grainwise.session import build_session  # noqa: E402
from tests.compare import difference, oracle_connection  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, registered = oracle_connection(folder), oracle_sql(), queries()
    keys = sys.argv[2:] or list(registered)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            problem = difference(registered[key](spark, folder), con, oracle[key])
        except Exception as error:  # report and go on with the next key
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {key} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} agree; no oracle: {[k for k in registered if k not in oracle]}")
