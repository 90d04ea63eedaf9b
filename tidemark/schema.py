"""The one row type, the options of a table, and snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: One version of a key. value is null only where tombstone is true; an empty value is live.
VERSIONS = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

#: Bound of a read that sees everything, and of garbage collection without live snapshots.
LATEST = (1 << 63) - 1
LEVELS = 7
#: Bytes that bookkeeping adds to each version in size estimates.
ENTRY_OVERHEAD = 64


@dataclass(frozen=True)
class Options:
    """Tunables of a table.

    flush_threshold_bytes: estimated size of pending writes at which they become a file.
    compaction_trigger: number of writes (flushes, bulk writes) in level 0 that starts a compaction.
    target_file_size: bytes of versions a compaction aims at in each file.
    l1_max_bytes, level_size_multiplier: size limit of level 1, and growth from level to level.
    cache_bytes: bytes of point reads' results kept in memory, 0 for none.
    auto_compact: whether a flush that reaches the trigger compacts.
    """

    flush_threshold_bytes: int = 4 << 20
    compaction_trigger: int = 4
    target_file_size: int = 2 << 20
    l1_max_bytes: int = 8 << 20
    level_size_multiplier: int = 10
    cache_bytes: int = 8 << 20
    auto_compact: bool = True

    def level_limit(self, level: int) -> int:
        return self.l1_max_bytes * self.level_size_multiplier ** (level - 1)


@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: versions with seq up to this one."""

    seq: int
