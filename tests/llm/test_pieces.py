"""Piece ids and decoding against the sentencepiece library."""

import hashlib
import sys

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tidemark.llm.pieces import PieceBpe, piece_digest, piece_ids

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
OWN = PieceBpe(PATH, capacity=20_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("abcdeth ▁  .,\n日é😀0<>s/", max_size=60), st.text(max_size=30), st.text("ab", max_size=50)), max_size=6))
def test_ids_and_text_are_the_librarys(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)]
    for text, raw in zip(texts, OWN.encode(texts)):
        ids = [OWN.bos, *np.frombuffer(raw, OWN.kind).tolist(), OWN.eos]
        assert ids == LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert OWN.decode(np.array(ids)) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258)), max_size=12))
def test_decoding_any_ids(ids):
    assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_documents(odd_docs, no_docs):
    from tests.llm.conftest import ODD_TEXTS

    want = set()
    for i, t in ODD_TEXTS:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = piece_digest(odd_docs, PATH).collect()
    assert len(got) == len(ODD_TEXTS) and {tuple(r) for r in got} == want
    assert piece_digest(no_docs, PATH).count() == 0
    assert {r.decoded for r in piece_ids(odd_docs, PATH).collect() if r.doc_id == 6} == {"three short words"}


def test_caches_are_bounded_by_bytes():
    """Long texts without spaces, each a word of its own: what is held stays below the bound and one batch."""
    own = PieceBpe(PATH, capacity=1 << 20)
    for i in range(12):
        texts = ["".join(chr(97 + (i * 7 + k * k + j) % 26) for k in range(20_000)) for j in range(4)]
        batch = sum(map(len, own.encode(texts)))
        size = sum(sys.getsizeof(k) + sys.getsizeof(v) for cache in (own.words, own.parts) for k, v in cache.items())
        assert size <= own.held <= (1 << 20) + 4 * (4 * 2 * 20_000 + 2 * batch)
    assert own.encode(["ab cd"])[0] == PieceBpe(PATH).encode(["ab cd"])[0]
