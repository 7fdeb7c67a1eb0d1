"""Run registered queries against their SQL checks: ``python tests/run_checks.py [sf_dir] [name…]``."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")

from tests.oracle import compare, connect  # noqa: E402


def main() -> None:
    import __spark_entry__ as entry
    from sensorloom.session import get_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    def wanted(n: str) -> bool:
        module = queries[n].__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1]
        return any(n == a or module == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)

    names = [n for n in queries if not args or wanted(n)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:1500]
        mark = ("ok  " if name in oracles else "rows") if problem is None else "FAIL"
        print(f"{mark} {name:32s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")


if __name__ == "__main__":
    main()
