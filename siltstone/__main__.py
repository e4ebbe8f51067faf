"""python -m siltstone VERB TABLE [FILTER | PROCEDURE]: summary, check, lookup, plan or files."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from siltstone.plans.facade import open_table


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("summary", "check", "lookup", "plan", "files"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    table = open_table(spark, args[1])
    if args[0] == "summary":
        table.summary().show(100, False)
    elif args[0] == "check":
        found = table.check().filter("verdict = 'DIFFERS'")
        found.show(100, False)
        return int(not found.isEmpty())
    elif args[0] == "lookup":
        table.lookup(args[2]).show(100, False)
    elif args[0] == "plan":
        table.plan(args[2] if len(args) > 2 else "expire", int(time.time() * 1000)).show(100, False)
    else:
        table.inventory().show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
