"""Run registered queries against their SQL: python tests/check_queries.py [root] [names...]"""

from __future__ import annotations

import sys
import time
import traceback

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

import oracle  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from kinetable.session import local_session  # noqa: E402


def main(root: str, names: list[str]) -> None:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(root)
    queries, sql = contract.queries(), contract.oracle_sql()
    chosen = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for name in chosen:
        try:
            start = time.time()
            got = queries[name](spark, root).toPandas()
            spent = time.time() - start
            if name in sql:
                t = time.time()
                want = con.execute(sql[name]).fetchdf()
                problem = oracle.difference(got, want)
                note = f"sql {time.time() - t:.1f}s"
            else:
                problem, note = (None if len(got) else "no rows"), "rows only"
        except Exception as error:  # report and go on to the next query
            problem, spent, note = f"{type(error).__name__}: {str(error)[:700]}", 0.0, ""
            if "-v" in sys.argv:
                traceback.print_exc()
            got = []
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '}{name:38s} {len(got):7d} rows {spent:6.2f}s {note} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} good, {len(queries)} registered, {len(sql)} with sql", flush=True)


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "-v"]
    main(args[0] if args else "/root/testdata/sf0.01", args[1:])
