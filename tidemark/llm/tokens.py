"""Byte-level BPE ids of whole texts, by the tokenizers library, each distinct word encoded once.

The library splits a text before every space that a visible character follows, whatever
stands around it, and merges never cross a split. A text's ids are therefore those of its
space-separated words, one after the other, and words repeat: a bounded cache holds the ids
of words already seen, and the library encodes the words that are new, many at a time.
Texts where a space meets white space or the text's end, or that hold a special token's
string, are given to the library whole.
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import slices

#: Fixed value: the pattern by which byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Bytes of a dictionary's entry besides its word and ids, about.
ENTRY = 100


def entry_bytes(word: str, ids: bytes | None) -> int:
    """What a dictionary holds for one entry, about."""
    return sys.getsizeof(word) + sys.getsizeof(ids) + ENTRY


def spaced(words: pa.Array) -> str:
    """Words of a large_string array with a space after each; none of them holds a space, so split(" ") finds them sooner than to_pylist()."""
    if not len(words):
        return ""
    joined = pc.binary_join_element_wise(words, *[pa.scalar(s, pa.large_string()) for s in ("", " ")])
    return str(memoryview(joined.buffers()[2])[: int(np.frombuffer(joined.buffers()[1], np.int64)[len(words)])], "utf-8")


def by_word(texts: list[str], ids_of, first_of) -> list[bytes | None]:
    """Each text's ids, put together from those of its space-separated words.

    ids_of maps an array of distinct words, as they stand after a space, to a
    binary array of their ids and a mask of words that have to be seen in their text; first_of maps words at a text's start
    to ids, or None for such a word. A text with one of those gives None. Splitting, numbering
    and joining run in Arrow, some texts at a time; Python sees distinct words alone.
    """
    return [ids for _, part in slices(texts) for ids in _by_word(part, ids_of, first_of)]


def _by_word(texts: list[str], ids_of, first_of) -> list[bytes | None]:
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    starts, words = np.asarray(lists.offsets), lists.values.dictionary_encode()
    codes = words.indices
    known, odd = ids_of(words.dictionary)
    firsts = words.dictionary.take(codes.take(pa.array(starts[:-1]))).to_pylist()
    odd_texts = set()
    if odd.any():
        at_start = np.zeros(len(codes), bool)
        at_start[starts[:-1]] = True
        places = np.flatnonzero(odd[np.asarray(codes)] & ~at_start)
        odd_texts = set((np.searchsorted(starts, places, "right") - 1).tolist())
    joined = known.take(codes)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(codes) + 1]
    raw = memoryview(joined.buffers()[2] or b"")
    unique = list(dict.fromkeys(firsts))
    heads = dict(zip(unique, first_of(unique)))
    a, b = ends[starts[:-1] + 1].tolist(), ends[starts[1:]].tolist()
    return [None if i in odd_texts or heads[w] is None else heads[w] + raw[a[i] : b[i]] for i, w in enumerate(firsts)]


class ByteBpe:
    """Encoder for one tokenizer file. capacity bounds the cache of pre-tokens in bytes: at half of it a new one begins, which takes over from the earlier what comes again. Results don't depend on it."""

    def __init__(self, path: str, capacity: int = 80 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.capacity, self.held = capacity, 0
        self.tokens: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids straight from the library."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, tokens: list[str]) -> None:
        """Encode pre-tokens not seen yet; those of a space and letters go to the library joined."""
        plain, rest = [], []
        for t in tokens:
            (plain if len(t) > 1 and t[0] == " " and t[1].isalpha() else rest).append(t)
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(part):
                raw, ends = ids.tobytes(), (np.append(cuts, len(ids)) * self.kind.itemsize).tolist()
                self.tokens.update((w, raw[a:b]) for w, a, b in zip(part, ends, ends[1:]))
            else:
                self.tokens.update(zip(part, self.whole(part)))
        self.tokens.update(zip(rest, self.whole(rest)))

    def _after_space(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        odd = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(words, special))
        plain = words.filter(pc.invert(odd))
        odd = np.asarray(odd)
        # Words that follow each other after single spaces split as each does alone.
        found = self.split(" " + spaced(plain)[:-1]) if len(plain) else []
        parts = pa.array(found, pa.large_string())
        coded = parts.dictionary_encode()
        opens = np.flatnonzero(np.asarray(pc.starts_with(parts, " ")))
        if len(opens) != len(plain):
            raise AssertionError("a word was split in an unknown way")
        codes, places = np.asarray(coded.indices), np.zeros(len(coded.dictionary), np.int64)
        places[codes[::-1]] = np.arange(len(codes))[::-1]
        tokens = [found[i] for i in places.tolist()]
        if self.held > self.capacity // 2:
            self.earlier, self.tokens, self.held = self.tokens, {}, 0
        new = [t for t in tokens if t not in self.tokens]
        known = list(map(self.earlier.get, new))
        self.tokens.update((t, ids) for t, ids in zip(new, known) if ids is not None)
        self._ids([t for t, ids in zip(new, known) if ids is None])
        self.held += sum(map(sys.getsizeof, new)) + sum(map(sys.getsizeof, map(self.tokens.__getitem__, new))) + ENTRY * len(new)
        joined = pa.array(list(map(self.tokens.__getitem__, tokens)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
        sizes = np.zeros(len(words), np.int64)
        sizes[~odd] = np.diff(np.append(ends[opens], ends[-1]))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), joined.buffers()[2] if len(parts) else pa.py_buffer(b"")]), odd

    def _at_start(self, words: list[str]) -> list[bytes | None]:
        return [None if any(s in w for s in self.special) else ids for w, ids in zip(words, self.whole(words))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian integers of self.kind."""
        out = by_word(texts, self._after_space, self._at_start)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out


loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each Python worker, which outlives a task."""
    if path not in loaded:
        loaded[path] = ByteBpe(path)
    return loaded[path]
