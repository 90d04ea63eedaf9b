"""Ids, token files and packing against the library and a plain loop."""

import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.packing import match, pack, place
from tidemark.llm.shared import cut
from tidemark.llm.token_files import BLOCK, FileReader, FileWriter, decode_blocks, encode_blocks, read_token_files, token_file_digest, write_token_files
from tidemark.llm.tokens import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = ByteBpe(PATH, capacity=20_000)

LETTERS = "abcdeThe  \n\t.,!'s12é日😀İ  <|>"


def by_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(LETTERS, max_size=40), st.text(max_size=20), st.just("a <|endoftext|> b")), max_size=8))
def test_ids_are_the_librarys(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)]
    assert [np.frombuffer(x, OWN.kind).tolist() for x in OWN.encode(texts)] == [by_library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 1000), st.sampled_from([0, 1, 300, 50_000, 2**32 - 1]), st.floats(0, 1))
def test_blocks_round_trip(seed, n, most, share):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, most + 1, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    blocks = encode_blocks(ids, share)
    assert len(blocks) == -(-n // BLOCK)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.uint64)
    assert decode_blocks(b"".join(blocks), index, n).tolist() == ids.tolist()


@pytest.mark.parametrize("chunk", [128, 1000, 1 << 20])
def test_file_round_trip(chunk):
    ids = [np.arange(n, dtype=np.uint16) for n in (0, 1, 127, 128, 129, 5000, 0, 3)]
    names, out = [None, 5, 6, 6, -7, 9, 10, 11], io.BytesIO()
    file, most = FileWriter(out, chunk=chunk), 0
    for name, x in zip(names, ids):
        file.add(name, x)
        most = max(most, file._held)
    assert most < max(chunk, BLOCK)  # what waits between documents
    file.close()
    got = FileReader(pa.BufferReader(out.getvalue()))
    assert got.docs == names and np.diff(got.starts).tolist() == list(map(len, ids))
    for most in (1, 200, 1 << 20):
        runs = list(got.runs(most))
        assert [x for a, b in runs for x in range(a, b)] == list(range(8))
        assert [got.ids(a, b).tolist() for a, b in runs] == [np.concatenate(ids[a:b]).tolist() for a, b in runs]
    for broken in (b"", out.getvalue()[:-1], b"x" * 100):
        with pytest.raises(ValueError):
            FileReader(pa.BufferReader(broken))


def expected(rows):
    return {(i, t): by_library(t) + [0] for i, t in rows}


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    from tests.llm.conftest import ODD_TEXTS

    files = write_token_files(odd_docs, PATH, folder=f"file://{tmp_path}/out", partitions=3)
    got = read_token_files(spark, files).collect()
    assert len(got) == len(ODD_TEXTS)
    ids = {tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in got}
    assert ids == {tuple(x) for x in expected(ODD_TEXTS).values()}
    at, last = 0, -1
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id if r.doc_id is not None else -1) >= last
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else -1
    several = write_token_files(odd_docs, PATH, folder=f"file://{tmp_path}/several", partitions=2, file_ids=30)
    assert len(several) > 3 and {(r.start, r.doc_id, r.ids) for r in read_token_files(spark, several).collect()} == {(r.start, r.doc_id, r.ids) for r in got}
    digest = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file_digest(odd_docs, PATH).collect()}
    assert digest == {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in expected(ODD_TEXTS).items()}
    assert token_file_digest(no_docs, PATH).count() == 0


def check_packing(rows, texts, room):
    want = sorted((i is not None, i or 0, len(by_library(t)) + 1) for i, t in texts)
    assert sum(r.length for r in rows) == sum(n for *_, n in want)
    by_sequence = {}
    for r in rows:
        assert 0 < r.length <= room
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return len(by_sequence)


def test_packing_odd_documents(odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    rows = pack(odd_docs, PATH, room=64).collect()
    used = check_packing(rows, ODD_TEXTS, 64)
    assert used <= 1.02 * sum(r.length for r in rows) / 64 + 2
    long = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 8)
    ids = by_library(dict(ODD_TEXTS)[8]) + [0]
    at = 0
    for k, (piece, start, length, crc) in enumerate(long):
        assert (piece, start) == (k, at) and (length == 64 or k == 0)
        assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
        at += length
    assert at == len(ids)
    assert pack(no_docs, PATH).count() == 0


def test_words_that_come_again_outlive_a_full_cache():
    """Common words among ever new ones: the library sees them once, and what is held stays below the bound and one slice."""
    own, seen = ByteBpe(PATH, capacity=200_000), []
    library = own._ids
    own._ids = lambda tokens: seen.extend(tokens) or library(tokens)
    common = [f"common{chr(97 + i)}" for i in range(26)]
    for k in range(30):
        text = " ".join(["x", *common, *(f"rare{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))])
        assert own.encode([text]) == own.whole([text])
        sizes = [sum(sys.getsizeof(w) + sys.getsizeof(i) for w, i in c.items()) for c in (own.tokens, own.earlier)]
        assert sum(sizes) <= 200_000 + 2 * 330 * 200
    assert own.earlier and all(seen.count(" " + w) == 1 for w in common)


def best_fit_decreasing(lengths, room):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(room - n)
    return len(gaps)


@pytest.mark.parametrize("seed,room,n,per_range", [(1, 20, 300, 40), (2, 64, 500, 1 << 18), (3, 64, 400, 60), (4, 8, 200, 30)])
def test_packing_is_as_good_as_best_fit_decreasing(spark, seed, room, n, per_range):
    rng = random.Random(seed)
    lengths = [min(room, 1 + int(rng.random() ** 2 * room)) if rng.random() < 0.7 else room // 3 for _ in range(n)]  # a length of a third of the pieces
    pieces, _ = cut(spark.createDataFrame(list(enumerate(lengths)), "pid long, length long"), "test-pieces")
    rows = place(pieces, room, per_range)[0].collect()
    assert sorted((r.pid, r.length) for r in rows) == list(enumerate(lengths))
    fill, order = {}, set()
    for r in rows:
        fill[r.seq] = fill.get(r.seq, 0) + r.length
        order.add((r.seq, r.slot))
    assert len(order) == n and max(fill.values()) <= room
    assert len(fill) <= best_fit_decreasing(lengths, room) + 1


@given(st.lists(st.booleans(), max_size=60))
def test_matching_is_that_of_a_stack(slots):
    stack, want = [], []
    for i, is_slot in enumerate(slots):
        if not is_slot:
            stack.append(i)
        elif stack:
            want.append((stack.pop(), i))
    a, b = match(np.array(slots, bool))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(want)
