"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a run of characters, the encoding's last token is unique. The table holds
it: among the vocabulary's tokens that end at the prefix (found by an automaton over the whole
run), it is the one that stands alone, if it starts the run, or that the last token of the
prefix before it can precede. Two tokens can stand next to each other if merging their joined
text gives just them. Ids are then read off backwards. Characters outside the vocabulary
become their UTF-8 bytes' tokens, and never merge.

No token holds a character after which a space mark stands, so words are encoded apart, and a
word's parts between characters that no token holds next to each other are too. Bounded caches
keep the ids of words and parts; the result doesn't depend on them. Null texts are empty; repeated rows
stay; an empty table gives no rows; other columns, of any name, are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import text_slices, texts_of
from .tokens import by_word, entry_bytes, spaced

MARK = "▁"
#: Pairs of tokens remembered at most; a pair is two strings of the vocabulary, so an entry has a bound.
PAIRS = 400_000


class PieceBpe:
    """Encoder and decoder for a BPE model with byte fallback, identity normalizer and dummy prefix.

    capacity bounds the cached words and parts in bytes, beyond which they begin anew with the next batch.
    """

    def __init__(self, path: str, capacity: int = 128 << 20):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte = {}
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        table = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                table.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                table.append(piece.replace(MARK, " ").encode())
        self.bytes_of, self.is_byte = table, np.array([model.is_byte(i) for i in range(len(table))])
        self.kind = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")
        self.beside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a token crosses words")
        self.automaton = ahocorasick.Automaton()
        self.stands: dict[str, bool] = {}
        for piece in self.id:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.capacity, self.held = capacity, 0
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes | None] = {}
        self.parts: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves: the best-scored pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _alone(self, token: str) -> bool:
        got = self.stands.get(token)
        if got is None:
            got = self.stands[token] = len(token) == 1 or self.merge(token) == [token]
        return got

    def _fit(self, a: str, b: str) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            got = self.fits[a, b] = self.merge(a + b) == [a, b]
        return got

    def _run(self, run: str) -> list[str]:
        """Tokens of a run of characters that are all in the vocabulary."""
        if run in self.id and self._alone(run):
            return [run]
        last: list[str] = [""] * (len(run) + 1)
        ending: list[list[str]] = [[] for _ in range(len(run) + 1)]
        for end, token in self.automaton.iter(run):
            ending[end + 1].append(token)
        for end in range(1, len(run) + 1):
            for token in sorted(ending[end], key=len, reverse=True):
                start = end - len(token)
                if self._alone(token) if not start else self._fit(last[start], token) and self._alone(token):
                    last[end] = token
                    break
        out, end = [], len(run)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _part(self, part: str) -> bytes:
        ids: list[int] = []
        run = ""
        for c in part:
            if c in self.id:
                run += c
                continue
            if run:
                ids += map(self.id.__getitem__, self._run(run))
                run = ""
            ids += map(self.byte.__getitem__, c.encode())
        if run:
            ids += map(self.id.__getitem__, self._run(run))
        return np.array(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        out, a, beside = [], 0, self.beside
        for k in range(1, len(word) + 1):
            if k == len(word) or word[k - 1 : k + 1] not in beside:
                part = word[a:k]
                got = self.parts.get(part)
                if got is None:
                    got = self.parts[part] = self._part(part)
                    self.held += entry_bytes(part, got)
                out.append(got)
                a = k
        return b"".join(out)

    def _marked(self, words: list[str]) -> list[bytes | None]:
        if self.held > self.capacity:
            self.words.clear()
            self.parts.clear()
            self.held = 0
        for w in words:
            if w not in self.words:
                got = self.words[w] = self._word(MARK + w) if w and MARK not in w else None
                self.held += entry_bytes(w, got)
        return list(map(self.words.__getitem__, words))

    def _after_space(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        known = self._marked(spaced(words).split(" ")[:-1])
        return pa.array([x or b"" for x in known], pa.large_binary()), np.fromiter((x is None for x in known), bool, len(known))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, without begin and end, as little-endian integers of self.kind."""
        out = by_word(texts, self._after_space, self._marked)
        for i, ids in enumerate(out):
            if ids is None:  # runs of spaces, or the mark itself
                text = MARK + texts[i].replace(" ", MARK) if texts[i] else ""
                out[i] = b"".join(map(self._word, re.findall(f"{MARK}+[^{MARK}]*", text)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one each."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        first = next((i for i in ids.tolist() if self.bytes_of[i] != b"" or i == self.unk), None)
        if first is not None and self.pieces[first].startswith(MARK):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(c if not 0xDC80 <= ord(c) <= 0xDCFF else "�" for c in raw.decode(errors="surrogateescape"))


loaded: dict[str, PieceBpe] = {}


def model(path: str) -> PieceBpe:
    """One model for each Python worker, which outlives a task."""
    if path not in loaded:
        loaded[path] = PieceBpe(path)
    return loaded[path]


def _map(docs: DataFrame, path: str, make, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    def encode(batches):
        bpe = model(path)
        for batch in batches:
            rows = []
            for raw in (raw for _, texts in text_slices(batch.column(1)) for raw in bpe.encode(texts)):
                ids = np.empty(len(raw) // bpe.kind.itemsize + 2, "<u4")
                ids[0], ids[1:-1], ids[-1] = bpe.bos, np.frombuffer(raw, bpe.kind), bpe.eos
                rows.append(make(bpe, ids))
            cols = list(zip(*rows)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(cols, columns))], ["doc_id", *(n for n, _, _ in columns)])

    return texts_of(docs).mapInArrow(encode, "doc_id long, " + ", ".join(f"{n} {s}" for n, _, s in columns))


def piece_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end ids) and decoded text of every document.

    A null text is the empty one, whose ids are begin and end alone; repeated rows stay; an
    empty table gives no rows.
    """
    return _map(docs, path, lambda bpe, ids: (ids.tobytes(), bpe.decode(ids)), [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")])


def piece_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""

    def make(bpe, ids):
        return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return _map(docs, path, make, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")])
