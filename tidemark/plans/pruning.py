"""Which files a read has to open, from the manifest alone."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from ..sources.manifest import FileMeta, Manifest


def for_point(m: Manifest, key: bytes, snapshot: int) -> list[FileMeta]:
    """Files that may hold a visible version of a key: at most one in each level above 0."""
    return [f for f in m.files if f.holds(key) and f.min_seq <= snapshot]


def for_range(m: Manifest, start: bytes | None, end: bytes | None, snapshot: int) -> list[FileMeta]:
    """Files that may hold a visible version of a key from start to end."""
    if start is not None and end is not None and start > end:
        return []
    return [f for f in m.files if f.meets(start, end) and f.min_seq <= snapshot]


def for_ranges(m: Manifest, ranges: list[tuple[bytes, bytes]], snapshot: int) -> list[FileMeta]:
    """Files that may hold a visible version of a key of some range."""
    ranges = sorted(r for r in ranges if r[0] <= r[1])
    starts, reach = [r[0] for r in ranges], list(accumulate((r[1] for r in ranges), max))

    def met(f: FileMeta) -> bool:
        before = bisect_right(starts, f.largest)
        return before > 0 and reach[before - 1] >= f.smallest

    return [f for f in m.files if f.min_seq <= snapshot and met(f)]
