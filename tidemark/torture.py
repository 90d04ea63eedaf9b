"""Crash test: a writer that may be killed at any time, and what must hold afterwards.

python -m tidemark.torture write FOLDER     numbers up to the last one acknowledged go to stdout
python -m tidemark.torture verify FOLDER    the length of the unbroken prefix, or an error
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import resolve
from .schema import Options
from .table import Table


def key(n: int) -> bytes:
    return b"key%08d" % n


def write(table: Table, acknowledged: Callable[[int], None], start: int, stop: int | None = None) -> None:
    """Put numbered keys from start, telling each once it is acknowledged."""
    n = start
    while stop is None or n < stop:
        table.put(key(n), b"val:" + key(n))
        acknowledged(n)
        n += 1


def verify(table: Table) -> int:
    """The number of keys, which must be all from 0 on with their values, without a gap."""
    rows = table.scan().select(F.substring(F.col("key").cast("string"), 4, 20).cast("long").alias("n"), (F.col("value") == F.concat(F.lit(b"val:"), F.col("key"))).alias("ok"))
    wrong = rows.where(~F.col("ok")).count()
    first, beyond = resolve.first_gap(rows, "n").first()
    if wrong or beyond:
        raise RuntimeError(f"{wrong} wrong values; key {first} is missing, with {beyond} keys after it")
    return first


def main(argv: list[str]) -> int:
    if len(argv) != 2 or argv[0] not in ("write", "verify"):
        print("usage: python -m tidemark.torture write|verify FOLDER", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("tidemark-torture").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with Table.open(spark, argv[1], Options(flush_threshold_bytes=4096)) as table:
        n = verify(table)
        print(n, flush=True)
        if argv[0] == "write":
            write(table, lambda k: print(k, flush=True), n)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
