"""spark.read.format("tidemark"): a table's versions as a data source.

Options: path, and optionally key, or start and end, by which files are pruned from the manifest
before any is read, and snapshot, which leaves later versions out. Rows are versions; resolve
them with operators.resolve. Pending writes of an open table are not in files, and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import pruning
from ..schema import LATEST, VERSIONS
from . import manifest


class _File(InputPartition):
    def __init__(self, path: str, base: int):
        self.path, self.base = path, base


def _open(root: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.key, self.start, self.end = (options[o].encode() if o in options else None for o in ("key", "start", "end"))
        self.snapshot = int(options.get("snapshot", LATEST))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _open(self.root)
        listed = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/manifest", allow_not_found=True)) if f.path.endswith(".json")]
        if not listed:
            return []
        with store.open_input_stream(max(listed)) as f:
            found = manifest.decode(f.read())
        if found is None:
            raise manifest.Damaged(f"{max(listed)} is damaged")
        if self.key is not None:
            files = pruning.for_point(found, self.key, self.snapshot)
        else:
            files = pruning.for_range(found, self.start, self.end, self.snapshot)
        return [_File(f.path, f.base) for f in files]

    def read(self, partition: _File) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        keep = pc.field("seq") <= self.snapshot - partition.base
        if self.key is not None:
            keep &= pc.field("key") == self.key
        if self.start is not None:
            keep &= pc.field("key") >= self.start
        if self.end is not None:
            keep &= pc.field("key") <= self.end
        store, base = _open(self.root)
        data = ds.dataset(f"{base}/{partition.path}", format="parquet", filesystem=store)
        for batch in data.to_batches(columns=["key", "seq", "tombstone", "value"], filter=keep):
            yield batch.set_column(1, batch.schema.field("seq"), pc.add(batch.column(1), partition.base))


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self):
        return VERSIONS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
