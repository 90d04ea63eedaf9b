"""What a compaction takes in, where it puts it, and whether anything older can lie below."""

from __future__ import annotations

from dataclasses import dataclass

from ..schema import ENTRY_OVERHEAD, LEVELS, Options
from ..sources.manifest import FileMeta, Manifest


@dataclass(frozen=True)
class Pick:
    inputs: tuple[FileMeta, ...]
    level: int
    bottommost: bool


def level_bytes(m: Manifest, level: int) -> int:
    return sum(f.entries for f in m.level(level)) * ENTRY_OVERHEAD


def runs(m: Manifest) -> int:
    """Writes held in level 0. The files of one lie in one folder and share no key, so they cost a read as much as one file does."""
    return len({f.path.rsplit("/", 1)[0] for f in m.level(0)})


def forced(m: Manifest) -> Pick | None:
    """Everything into level 1; nothing is left below."""
    return Pick(tuple(m.files), 1, True) if m.files else None


def _with_overlap(m: Manifest, inputs: list[FileMeta], level: int) -> Pick:
    """inputs and the files of the output level that meet their range, which may be the empty key's."""
    smallest, largest = min(f.smallest for f in inputs), max(f.largest for f in inputs)
    below = [f for f in m.level(level) if f.meets(smallest, largest)]
    deeper = any(f.level > level for f in m.files)
    return Pick(tuple(inputs + below), level, not deeper)


def due(m: Manifest, options: Options) -> Pick | None:
    """Level 0 when it has enough writes; else the oldest file of the first level over its limit."""
    top = m.level(0)
    if top and runs(m) >= options.compaction_trigger:
        return _with_overlap(m, top, 1)
    for level in range(1, LEVELS - 1):
        files = m.level(level)
        if files and level_bytes(m, level) > options.level_limit(level):
            return _with_overlap(m, [min(files, key=lambda f: f.number)], level + 1)
    return None


def settled(m: Manifest) -> bool:
    """Whether a forced compaction has nothing left to do: no level-0 files, one populated level."""
    return not m.level(0) and len({f.level for f in m.files}) <= 1
