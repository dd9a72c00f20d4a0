"""Command line: compare queries with their SQL. usage: check_queries.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sparktally.session import local_session  # noqa: E402
from tests.compare import differences, duck  # noqa: E402


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                diff, n = differences(df, con, oracles[name])
            else:
                diff, n = [], len(df.collect())
        except Exception as e:  # report and go on
            diff, n = [f"{type(e).__name__}: {str(e)[:600]}"], -1
        failed += bool(diff)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind} {name:32s} {n:7d} rows {time.time() - start:6.2f}s",
              *diff, flush=True)
    print(f"{failed} failed of {len(names or queries)}")


if __name__ == "__main__":
    main()
