"""Command line: compare queries with their SQL. usage: run_oracles.py [sf] [name-prefix ...]"""

from __future__ import annotations

import sys
import time
import traceback

from conftest import TESTDATA, build_session

import compare
from migraspark.catalog import load


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    folder = f"{TESTDATA}/sf{scale}"
    spark = build_session()
    connection = compare.connect(folder)
    queries, oracles = load()
    failed = 0
    for name, build in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in oracles:
                problems = compare.differences(df, oracles[name], connection)
                label = "ok"
            else:
                count = df.count()
                problems = [] if count else ["no rows"]
                label = f"rows only ({count})"
        except Exception:
            problems, label = [traceback.format_exc()[-2500:]], ""
        failed += bool(problems)
        print(f"{name}: {problems and 'FAIL' or label} {time.time() - started:.1f}s", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
