"""Token ids in patched frame-of-reference blocks, in binary files of a shared folder.

A file holds one range of documents in ascending doc_id order, and is written as they come:

    magic "TMPF", u32 version
    blocks: u32 minimum, u8 width, u8 exceptions, packed low bits of id - minimum,
            u8 place and u32 high bits of each exception
    footer: i64 doc_id of each document, u8 whether it is null, u64 ids of the file before it,
            u64 place of each block of 128 ids (the block index), then the blocks' end
    u64 documents, u64 ids, u64 place of the footer, magic

The width of a block is the least that holds the given share of its differences; wider ones
are exceptions. All numbers are little-endian. Files are written under another name and then
renamed, so a task that runs again, after an executor is lost, replaces a file by an equal one.
A task begins another file at FILE_IDS ids or FILE_DOCS documents, and holds CHUNK ids besides a batch,
and its file's footer; a reader holds the footer and about CHUNK ids, or one longer document.

Null texts are empty documents; null doc_ids come first; repeated doc_ids are documents of
their own, next to each other, ordered by a hash of their text. An empty table has no files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch_path, shuffle_partitions, text_slices, texts_of
from .tokens import encoder

MAGIC, VERSION, BLOCK = b"TMPF", 2, 128
CHUNK, FILE_IDS, FILE_DOCS = 1 << 20, 1 << 26, 1 << 20
STEP = 1024  # blocks packed at a time, so that they stay in the processor's cache
_HEAD, _TAIL = struct.Struct("<4sI"), struct.Struct("<QQQ4s")


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 2 * width 64-bit words."""
    out = np.zeros((2 * width, len(low)), np.uint64)
    if not width:
        return out.T
    for i, v in enumerate(np.ascontiguousarray(low.T).astype(np.uint64)):
        word, bit = divmod(i * width, 64)
        out[word] |= v << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= v >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    cols, out = np.ascontiguousarray(words.T), np.zeros((BLOCK, len(words)), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        v = cols[word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | cols[word + 1] << np.uint64(64 - bit)
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """Blocks of 128 ids; the last is filled up with its minimum."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    diff = full - least[:, None]
    at = max(0, int(np.ceil(share * BLOCK)) - 1)
    chosen = np.partition(diff, at, axis=1)[:, at]
    widths = np.zeros(n, np.int64)
    widths[chosen > 0] = np.floor(np.log2(chosen[chosen > 0])).astype(np.int64) + 1
    high = (diff.astype(np.uint64) >> widths.astype(np.uint64)[:, None]).astype(np.uint32)
    out: list[bytes] = [b""] * n
    odd_rows, odd_places = np.nonzero(high)
    odd_values, odd_places = high[odd_rows, odd_places].astype("<u4").tobytes(), odd_places.astype(np.uint8).tobytes()
    ends = np.searchsorted(odd_rows, np.arange(n + 1)).tolist()
    heads, minima = struct.Struct("<IBB").pack, least.tolist()
    for width in np.unique(widths).tolist():
        at_width = np.flatnonzero(widths == width)
        for rows in (at_width[i : i + STEP] for i in range(0, len(at_width), STEP)):
            packed, size = _pack(diff[rows] & np.uint32((1 << width) - 1), width).tobytes(), 16 * width
            for k, r in enumerate(rows.tolist()):
                a, b = ends[r], ends[r + 1]
                out[r] = heads(minima[r], width, b - a) + packed[k * size : (k + 1) * size] + odd_places[a:b] + odd_values[4 * a : 4 * b]
    return out


def decode_blocks(raw: bytes, index: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(index) - 1
    out = np.zeros((n, BLOCK), np.uint32)
    bytes_ = np.frombuffer(raw, np.uint8)
    heads = bytes_[index[:-1, None].astype(np.int64) + np.arange(6)] if n else np.zeros((0, 6), np.uint8)
    least = heads[:, :4].copy().view("<u4")[:, 0]
    for width in np.unique(heads[:, 4]):
        at_width, w = np.flatnonzero(heads[:, 4] == width), int(width)
        for rows in (at_width[i : i + STEP] for i in range(0, len(at_width) if w else 0, STEP)):
            body = b"".join([raw[a : a + 16 * w] for a in (index[rows].astype(np.int64) + 6).tolist()])
            out[rows] = _unpack(np.frombuffer(body, "<u8").reshape(len(rows), 2 * w), w).astype(np.uint32)
    for r in np.flatnonzero(heads[:, 5]):
        n_odd, at = int(heads[r, 5]), int(index[r]) + 6 + 16 * int(heads[r, 4])
        out[r, bytes_[at : at + n_odd]] |= np.frombuffer(raw, "<u4", n_odd, at + n_odd) << np.uint32(heads[r, 4])
    return (out + least[:, None]).reshape(-1)[:n_ids]


class FileWriter:
    """One file, written to a binary stream as documents come."""

    def __init__(self, out, share: float = 0.9, chunk: int = CHUNK):
        self.out, self.share, self.chunk = out, share, max(BLOCK, chunk)
        self.docs: list = []
        self.starts: list[int] = []
        self.n_ids, self._held, self._waiting = 0, 0, []
        self._index, self._at = [], _HEAD.size
        out.write(_HEAD.pack(MAGIC, VERSION))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self._held += len(ids)
        self._waiting.append(ids)
        if self._held >= self.chunk:
            self._write(self._held // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        """Blocks of the first n ids that wait."""
        ids = np.concatenate(self._waiting) if self._waiting else np.zeros(0, np.uint32)
        for at in range(0, n, self.chunk // BLOCK * BLOCK):
            blocks = encode_blocks(ids[at : min(n, at + self.chunk // BLOCK * BLOCK)], self.share)
            ends = self._at + np.cumsum([len(b) for b in blocks])
            self._index.append(np.concatenate([[self._at], ends[:-1]]))
            self._at = int(ends[-1])
            self.out.write(b"".join(blocks))
        self._waiting, self._held = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        """Write what waits, and the footer."""
        self._write(self._held)
        for part in (np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], np.uint8), np.array(self.starts, "<u8"), np.concatenate([*self._index, [self._at]]).astype("<u8")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(len(self.docs), self.n_ids, self._at, MAGIC))


class FileReader:
    """A file opened for reading in any order: doc_ids, starts (with the end), and the ids of runs of documents."""

    def __init__(self, f):
        self._f = f
        n_docs, n_ids, footer, magic = _TAIL.unpack(self._span(f.size() - _TAIL.size, _TAIL.size)) if f.size() >= _HEAD.size + _TAIL.size else (0, 0, 0, b"")
        if magic != MAGIC or _HEAD.unpack(self._span(0, _HEAD.size)) != (MAGIC, VERSION):
            raise ValueError("not a token file")
        raw, at = self._span(footer, f.size() - _TAIL.size - footer), 17 * n_docs
        null = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.docs = [None if z else d for d, z in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), null)]
        self.starts = np.append(np.frombuffer(raw, "<u8", n_docs, 9 * n_docs), np.uint64(n_ids)).astype(np.int64)
        self._index = np.frombuffer(raw, "<u8", -(-n_ids // BLOCK) + 1, at).astype(np.int64)

    def _span(self, at: int, size: int) -> bytes:
        self._f.seek(at)
        return self._f.read(size)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids of documents a to b, one after the other."""
        start, end = int(self.starts[a]), int(self.starts[b])
        first, last = start // BLOCK, -(-end // BLOCK)
        if first >= last:
            return np.zeros(0, np.uint32)
        places = self._index[first : last + 1]
        got = decode_blocks(self._span(int(places[0]), int(places[-1] - places[0])), places - places[0], (last - first) * BLOCK)
        return got[start - first * BLOCK : end - first * BLOCK]

    def runs(self, most: int = CHUNK, docs: int = 512):
        """(a, b) of runs of documents of about `most` ids."""
        a = 0
        while a < len(self.docs):
            b = int(np.searchsorted(self.starts, self.starts[a] + most, "right")) - 1
            b = min(max(a + 1, b), a + docs, len(self.docs))
            yield a, b
            a = b


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, share: float = 0.9, partitions: int | None = None, file_ids: int = FILE_IDS) -> list[tuple[str, int, int]]:
    """Write docs' ids as files of one doc_id range each; returns (file, documents, ids) in order.

    The driver receives these three values a file. partitions is the number of ranges that tasks
    take, by default the session's shuffle partitions; a task's range is one file or, beyond file_ids, several.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    n = partitions or shuffle_partitions(spark)

    def write(batches):
        bpe, part, made = encoder(tokenizer), TaskContext.get().partitionId(), 0
        store, base = _store(folder)
        to = out = name = None

        def done():
            to.close()
            out.close()
            store.move(name, f"{base}/part-{part:06d}-{made:06d}.tmpf")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([made], pa.int64()), pa.array([f"{folder}/part-{part:06d}-{made:06d}.tmpf"]), pa.array([len(to.docs)], pa.int64()), pa.array([to.n_ids], pa.int64())], ["part", "nth", "file", "n_docs", "n_ids"])

        for batch in batches:
            coded = (raw for _, texts in text_slices(batch.column(1)) for raw in bpe.encode(texts))
            for doc, raw in zip(batch.column(0).to_pylist(), coded):
                if to is None:
                    store.create_dir(base, recursive=True)
                    name = f"{base}/.part-{part:06d}-{made:06d}-{TaskContext.get().taskAttemptId()}"
                    out = store.open_output_stream(name)
                    to = FileWriter(out, share)
                to.add(doc, np.append(np.frombuffer(raw, bpe.kind), bpe.kind.type(end_id)))
                if to.n_ids >= file_ids or len(to.docs) >= FILE_DOCS:
                    yield done()
                    to, made = None, made + 1
        if to is not None:
            yield done()

    rows = texts_of(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    wrote = rows.select("doc_id", "text").mapInArrow(write, "part long, nth long, file string, n_docs long, n_ids long")
    return [(r.file, r.n_docs, r.n_ids) for r in sorted(wrote.collect())]


def _read(spark, files: list[tuple[str, int, int]], of_doc, column: str, kind: pa.DataType) -> DataFrame:
    """(doc_id, start, n_tokens) of each document in the files, and what of_doc makes of its ids."""
    schema = f"doc_id long, start long, n_tokens long, {column} {'binary' if kind == pa.binary() else 'long'}"
    if not files:
        return spark.createDataFrame([], schema)
    before, rows = 0, []
    for name, _, n_ids in files:
        rows.append((name, before))
        before += n_ids

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _store(name)
                with store.open_input_file(path) as f:
                    file = FileReader(f)
                    for a, b in file.runs():
                        starts, ids = file.starts[a : b + 1], file.ids(a, b).astype("<u4")
                        made = [of_doc(ids[i:j]) for i, j in zip(starts - starts[0], starts[1:] - starts[0])]
                        yield pa.RecordBatch.from_arrays([pa.array(file.docs[a:b], pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(made, kind)], ["doc_id", "start", "n_tokens", column])

    return spark.createDataFrame(rows, "file string, base long").repartition(len(rows)).mapInArrow(read, schema)


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids, as little-endian unsigned 32-bit integers, of each document."""
    return _read(spark, files, lambda ids: ids.tobytes(), "ids", pa.binary())


def token_file_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written."""
    return _read(docs.sparkSession, write_token_files(docs, tokenizer, **options), lambda ids: zlib.crc32(ids), "ids_crc32", pa.int64())
