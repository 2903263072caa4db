"""python -m textquarry COMMAND ARGUMENT...: rg, grep, find, fd, cat or search on this machine's files."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from textquarry.plans.commands import dispatch


def main(argv: list[str]) -> int:
    if not argv:
        sys.stderr.write("usage: python -m textquarry {rg,grep,find,fd,cat,search} ARGUMENT...\n")
        return 2
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    out = dispatch(spark, argv[0], argv[1:])
    sys.stdout.write(out.stdout)
    sys.stderr.write(out.stderr)
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
