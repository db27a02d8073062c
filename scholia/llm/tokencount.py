"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that the worker hasn't met before are held as one ragged array of symbols. In each round
every sequence looks up the ranks of its neighbouring pairs, takes its lowest and merges all its places at once, left
to right; sequences without a mergeable pair are done. The surviving symbols are the tokens.

Nulls are empty texts with 0 bytes and 0 tokens. Special tokens within texts count as one, as the library finds them.
Texts are counted whole, whatever their length. Rows may repeat; each is counted by itself.
Empty tables give no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pieces import PATTERN, REMEMBERED, cut, default_vocabulary, vocabulary

#: Symbols that one round of merging holds at most, but for longer single sequences.
SYMBOLS = 1 << 20
_NONE = np.int32(np.iinfo(np.int32).max)


class Counter:
    """Counts tokens with one vocabulary; one for each Python worker."""

    def __init__(self, path: str):
        self.vocabulary = v = vocabulary(path)
        n = len(v.tokens)
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(v.merges):
            pairs.setdefault(a * n + b, (rank, v.ids[v.tokens[a] + v.tokens[b]]))
        # An open-addressed table of the merges: two gathers or so for each pair.
        self.n, self.bits = n, 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        keys = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        slot = self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[put], values[put, 0], values[put, 1]
            left = np.setdiff1d(np.arange(len(keys)), put)
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)
        self.known: dict[str, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (the largest value: no merge) and the tokens they make."""
        keys = a.astype(np.int64) * self.n + b
        slot = self._slot(keys)
        at = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slot[left]]
            hit = found == keys[left]
            at[left[hit]] = slot[left[hit]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            if not len(left):
                break
        return np.where(at >= 0, self.ranks[at], _NONE), self.made[at]

    def merged(self, words: list[bytes]) -> np.ndarray:
        """For each sequence of bytes, how many symbols are left after all merges."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = sizes.copy()
        symbols = self.vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            inner = owner[:-1] == owner[1:]
            rank, made = self.look_up(symbols[:-1], symbols[1:])
            rank = np.where(inner, rank, _NONE)
            begin = np.flatnonzero(np.concatenate([[True], ~inner]))
            lowest = np.minimum.reduceat(np.append(rank, _NONE), begin)
            going = lowest < _NONE
            if not going.any():
                break
            runs = np.diff(np.append(begin, len(symbols)))
            least = np.repeat(lowest, runs)
            take = np.flatnonzero((rank == least[:-1]) & (rank < _NONE))
            if len(take) > 1:  # of overlapping places, as in aaa, every other one from the left
                fresh = np.concatenate([[True], np.diff(take) > 1])
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0))
                take = take[(np.arange(len(take)) - head) % 2 == 0]
            symbols[take] = made[take]
            keep = np.repeat(going, runs)  # finished sequences leave
            keep[take + 1] = False
            np.subtract.at(out, owner[take], 1)
            symbols, owner = symbols[keep], owner[keep]
        return out

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each pre-token."""
        out: dict[str, int] = {}
        block: list[str] = []
        size = 0
        for w in words:
            block.append(w)
            size += len(w)
            if size >= SYMBOLS:
                out.update(zip(block, self.merged([x.encode() for x in block]).tolist()))
                block, size = [], 0
        if block:
            out.update(zip(block, self.merged([x.encode() for x in block]).tolist()))
        return out

    def texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        special, splitter = self.vocabulary.special, self.vocabulary.splitter
        extra = [0] * len(texts)
        parts: list[list[str]] = []
        missing: set[str] = set()
        whole: list[list[str]] = []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i, text in enumerate(texts):
            own, odd = [], []
            some = [text or ""]
            if splitter is not None and text and any(s in text for s in special):
                some = [p for p in splitter.split(text) if p]
                extra[i] = sum(p in special for p in some)
                some = [p for p in some if p not in special]
            for p in some:
                pieces = cut(p)
                if pieces is None:
                    odd += PATTERN.findall(p)
                else:
                    odd += PATTERN.findall(pieces[0])
                    own += pieces[1:]
            parts.append(own)
            whole.append(odd)
            missing.update(own)
        missing.difference_update(self.known)
        found = {p: PATTERN.findall(" " + p) for p in missing}
        words = self.counts(list({w for ws in found.values() for w in ws} | {w for ws in whole for w in ws}))
        for p, ws in found.items():
            self.known[p] = sum(words[w] for w in ws)
        get = self.known.__getitem__
        return [e + sum(map(get, own)) + sum(words[w] for w in odd) for e, own, odd in zip(extra, parts, whole)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The worker's counter for that vocabulary."""
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text."""
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                n = pa.array(own.texts(texts), pa.int64())
                size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
                over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
