"""BPE encoding and decoding with a backtracking encoder.

An Aho-Corasick automaton of the vocabulary gives, at each position, the longest token that matches; a token is taken
if it may stand next to the one before it, which a pair-compatibility table tells: two tokens are compatible if no
merge across their border comes before the merges inside them. Where none of the shorter prefixes is compatible
either, the encoder steps back over the last token, and a bit for each position keeps it from trying the same place
twice. So each pre-token takes linear time and gets just the tokens that the merges give. Decoding looks up each id's
bytes in one buffer by an offset table.

Nulls are empty texts. Empty texts have no tokens. Special tokens within texts are found first, as the library does.
Texts of any length are encoded whole. Rows may repeat; each is encoded by itself; other columns pass untouched. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .pieces import PATTERN, cut, default_vocabulary, vocabulary

#: Pre-tokens, pieces between spaces and pairs that a task remembers before it starts afresh (some 200 MB in all).
WORDS, PIECES, PAIRS = 600_000, 250_000, 1_000_000


class Backtracking:
    """Encoder and decoder over one vocabulary; one for each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        tokens = self.vocabulary.tokens
        n = len(tokens)
        self.joined = {pair: self.vocabulary.ids[tokens[pair[0]] + tokens[pair[1]]] for pair in self.vocabulary.merges}
        self.left, self.right, self.rank = list(range(n)), list(range(n)), [-1] * n
        for rank, (a, b) in enumerate(self.vocabulary.merges):
            token = self.joined[a, b]
            if self.rank[token] < 0:
                self.left[token], self.right[token], self.rank[token] = a, b, rank
        self.order = {pair: rank for rank, pair in reversed([*enumerate(self.vocabulary.merges)])}
        self.length = [len(t) for t in tokens]
        self.good = [False] * n
        for i in sorted(self.vocabulary.ids.values(), key=self.rank.__getitem__):
            self.good[i] = self.reachable(i)
        self.usable = {token: i for token, i in self.vocabulary.ids.items() if self.good[i]}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.usable.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        #: The longest shorter token that a token begins with, by id; -1 for none. Filled as needed.
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def forget(self) -> None:
        """Gives back what was remembered, so that a worker that waits for other stages' tasks doesn't hold it."""
        self.compatible, self.words, self.known = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def fits(self, a: int, b: int) -> bool:
        """Whether merges leave the border between tokens a and b: undo the later of the two merges, again and again."""
        found = self.compatible.get((a, b))
        if found is None:
            if len(self.compatible) > PAIRS:
                self.compatible.clear()
            found = self.compatible[a, b] = self._fits(a, b)
        return found

    def _fits(self, a: int, b: int) -> bool:
        # `until`: the border's pair must not be merged before this rank, at which the token that holds it is made;
        # ties go to the left pair, so on the right side a pair of the same rank still comes first.
        until = len(self.order) + 1
        while True:
            rank = self.order.get((a, b))
            if rank is not None and rank < until:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until, a = self.rank[a], self.right[a]
            else:
                until, b = self.rank[b] + 1, self.left[b]

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, or -1."""
        found = self.shorter.get(token)
        if found is None:
            whole = self.vocabulary.tokens[token]
            ends = range(len(whole) - 1, 0, -1)
            found = self.shorter[token] = next((i for k in ends if (i := self.usable.get(whole[:k])) is not None), -1)
        return found

    def matches(self, word: str) -> list[int]:
        """The longest token that begins at each position, from one pass of the automaton."""
        longest = [-1] * len(word)
        for end, (token, back) in self.automaton.iter(word):
            longest[end - back] = token  # matches come by their ends, so later ones are longer
        return longest

    def word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.usable.get(raw)
        if whole is not None:
            return [whole]
        longest, length, compatible = self.matches(raw.decode("latin-1")), self.length, self.compatible
        out: list[int] = []
        at, size, open_ = 0, len(raw), bytearray(b"\x01") * (len(raw) + 1)
        token, last = longest[0], -1
        while True:
            end = at + length[token]
            if open_[end]:
                fits = last < 0 or compatible.get((last, token))
                if fits or fits is None and self.fits(last, token):
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            while (shorter := self.prefix(token)) < 0:
                open_[at] = 0
                token = out.pop()
                at -= length[token]
            token, last = shorter, out[-1] if out else -1

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token: its halves are reachable and only its own merge joins them."""
        if self.rank[token] < 0:
            return self.length[token] == 1
        a, b = self.left[token], self.right[token]
        own = self.order.pop((a, b))
        try:
            return self.good[a] and self.good[b] and self._fits(a, b)
        finally:
            self.order[a, b] = own

    def piece(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
        words = self.words
        out = []
        for w in PATTERN.findall(text):
            ids = words.get(w)
            if ids is None:
                if len(words) > WORDS:
                    words.clear()
                own = self.word(w.encode())
                ids = words[w] = _packed(len(own)).pack(*own)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        splitter = self.vocabulary.splitter
        if splitter is None or not any(s in text for s in self.vocabulary.special):
            return self.ordinary(text)
        special = self.vocabulary.special
        return b"".join(special[p].to_bytes(4, "little") if p in special else self.ordinary(p) for p in splitter.split(text) if p)

    def ordinary(self, text: str) -> bytes:
        """As `encode`, for a text without special tokens."""
        pieces = cut(text)
        if pieces is None:
            return self.piece(text)
        known = self.known
        out = [self.piece(pieces[0])]
        try:
            out += [known[p] for p in pieces[1:]]
        except KeyError:
            if len(known) > PIECES:
                known.clear()
            for p in pieces[1:]:
                if p not in known:
                    known[p] = self.piece(" " + p)
            del out[1:]
            out += [known[p] for p in pieces[1:]]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text that the ids stand for."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        begin = self.offsets[tokens]
        size = self.offsets[tokens + 1] - begin
        if not len(size):
            return b""
        place = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        raw = self.blob[place].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


@lru_cache(maxsize=64)
def _packed(n: int) -> struct.Struct:
    return struct.Struct(f"<{n}I")


@lru_cache(maxsize=2)
def coder(path: str) -> Backtracking:
    """The worker's encoder for that vocabulary."""
    return Backtracking(path)


def encode(docs: DataFrame, vocabulary_path: str | None = None, column: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the binary column `ids`: the tokens of `column` as little-endian unsigned 32-bit integers."""
    path = vocabulary_path or default_vocabulary()
    return _mapped(docs, column, ids, T.BinaryType(), lambda values: [coder(path).encode(v) for v in values], lambda: coder(path).forget())


def decode(docs: DataFrame, vocabulary_path: str | None = None, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """`docs` with the string column `column`: the text of the tokens in `ids`; null ids give an empty text."""
    path = vocabulary_path or default_vocabulary()
    return _mapped(docs, ids, column, T.StringType(), lambda values: [coder(path).decode(v or b"").decode() for v in values], lambda: coder(path).forget())


def _mapped(docs: DataFrame, source: str, target: str, kind: T.DataType, f, forget) -> DataFrame:
    docs = docs.drop(target)
    schema = T.StructType([*docs.schema.fields, T.StructField(target, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(f(batch.column(source).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, target])
        forget()

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, then decoded from the ids."""
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        try:
            for batch in batches:
                n, a, b = [], [], []
                for text in batch.column("text"):
                    ids = own.encode(text.as_py())
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
