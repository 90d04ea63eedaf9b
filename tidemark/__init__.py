"""Multi-version keyed tables on PySpark.

A table is a log of versions (key, seq, tombstone, value). Reads resolve, for each key, the
newest version that a snapshot can see; maintenance rewrites the log without changing what any
live snapshot sees.
"""

from .schema import Options, Snapshot, VERSIONS
from .table import Table

__all__ = ["Options", "Snapshot", "Table", "VERSIONS"]
