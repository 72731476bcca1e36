"""python tests/run_compare.py [sf_dir] [query ...]: compare and time registered queries."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from compare import connect, differences  # noqa: E402
from session import session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = session(), connect(sf_dir)
    oracle, wanted = entry.oracle_sql(), sys.argv[2:]
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = differences(df, connection, oracle[name]) if name in oracle else [f"rows only: {df.count()}"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found) and name in oracle
        print(f"{name:26s} {time.time() - start:6.2f}s {'ok' if not found else found}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
