"""A command line over one table: put, get, del, scan, flush, compact, snapshots.

python -m tidemark.repl FOLDER
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from .schema import Snapshot
from .table import Table

HELP = """put <key> <value>
get <key> [snapshot]
del <key>
scan <start> <end> [snapshot]
snapshot
release <snapshot>
flush
compact
help
exit"""


def run(table: Table, lines: Iterable[str], say=print) -> None:
    """Answer each line until exit or the end. Words are split at white space."""
    for line in lines:
        words = line.split()
        if not words:
            continue
        command, args = words[0], words[1:]
        if command in ("exit", "quit"):
            return
        answer = _COMMANDS.get(command)
        if answer is None:
            say("ERR: unknown command")
            continue
        usage, low, high, f = answer
        if not low <= len(args) <= high:
            say(f"ERR: {usage}")
            continue
        try:
            f(table, args, say)
        except ValueError as e:
            say(f"ERR: {e}")


def _at(args: list[str], place: int) -> Snapshot | None:
    return Snapshot(int(args[place])) if len(args) > place else None


def _put(table, args, say):
    table.put(args[0].encode(), args[1].encode())
    say("OK")


def _get(table, args, say):
    got = table.get(args[0].encode(), _at(args, 1))
    say("(nil)" if got is None else got.decode(errors="replace"))


def _del(table, args, say):
    table.delete(args[0].encode())
    say("OK")


def _scan(table, args, say):
    n = 0
    for key, value in table.each(args[0].encode(), args[1].encode(), _at(args, 2)):
        say(f"{key.decode(errors='replace')} = {value.decode(errors='replace')}")
        n += 1
    say(f"({n} results)")


def _release(table, args, say):
    table.release(Snapshot(int(args[0])))
    say("OK")


def _ok(f):
    def call(table, args, say):
        f(table)
        say("OK")

    return call


_COMMANDS = {
    "put": ("put <key> <value>", 2, 2, _put),
    "get": ("get <key> [snapshot]", 1, 2, _get),
    "del": ("del <key>", 1, 1, _del),
    "scan": ("scan <start> <end> [snapshot]", 2, 3, _scan),
    "snapshot": ("snapshot", 0, 0, lambda table, args, say: say(str(table.snapshot().seq))),
    "release": ("release <snapshot>", 1, 1, _release),
    "flush": ("flush", 0, 0, _ok(Table.flush)),
    "compact": ("compact", 0, 0, _ok(Table.compact)),
    "help": ("help", 0, 0, lambda table, args, say: say(HELP)),
}


def main(argv: list[str]) -> int:
    if len(argv) != 1:
        print("usage: python -m tidemark.repl FOLDER", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    with Table.open(spark, argv[0]) as table:
        run(table, sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
