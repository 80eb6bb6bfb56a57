"""Run queries against their SQL from the command line: check.py FOLDER [NAME...]"""

from __future__ import annotations

import sys
import time
import traceback

from newsweave.catalog import all_queries, all_sql
from newsweave.session import build_session
from tests.oracle import connect, differences


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = all_queries(), all_sql()
    chosen = [n for n in queries if not names or any(p in n for p in names)]
    connection = connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problems = differences(df, connection, sql[name])
            else:
                rows = df.collect()
                problems = [] if rows else ["no rows"]
                if rows:
                    print("   ", len(rows), rows[0])
        except Exception as error:  # report and go on
            problems = ["".join(traceback.format_exception_only(error))[:1500]]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {'sql' if name in sql else 'rows'}", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
    print(f"{len(chosen)} queries, {bad} bad")


if __name__ == "__main__":
    main()
