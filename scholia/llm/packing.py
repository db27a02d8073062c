"""Packing documents into sequences by vector best-fit.

A piece has a length, counts as one document and costs attention (its length squared); a sequence has a capacity for each.
Pieces are placed by falling length. Of the open sequences that take a piece under every constraint, it goes to the one
that the rule selects: `norm`, the least weighted norm of the residual capacities after it (the fullest); `dot`, the greatest
weighted dot-product of the piece and the residual capacities. Without one, a new sequence is opened.

All three costs follow from the length, so pieces of one length are alike, and so are sequences of one residual. The packing is
therefore planned from the number of pieces of each length, which are no more than `capacity` numbers whatever the corpus, over ranges
of alike sequences. For `norm`, a sequence that has taken a piece is the fullest, and takes the next of that length while it can, so a whole
range is filled at once; `dot` fills it by one piece each, and new sequences at once. Each of the RULES is planned and that with the fewest sequences taken. A plan's steps are bounded by the capacity
alone: a length splits at most two ranges, and a sequence takes pieces of less than sqrt(2 capacity) different lengths.
Spark then ranks the pieces of each length (in buckets, so that a length with a third of all pieces isn't one task's) and finds each
one's sequence and offset by its rank.

Null texts are empty. Each document ends with a token 0, so an empty one is that token. Documents over the capacity are cut into full pieces, the
first of which may be shorter; no other is cut. Rows that repeat are packed each, null ids too. An empty table gives no rows. Texts of any length count
whole. Columns other than doc_id and text aren't read. Equal rows may change places, which no result shows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import coder
from .common import table, written
from .pieces import PATTERN, default_vocabulary, vocabulary

#: The token after each document.
END = 0
#: Rules that are planned: how a sequence is selected, with weights for tokens, documents and attention.
RULES: tuple[tuple[str, tuple[float, float, float]], ...] = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.25, 0.25)), ("dot", (1.0, 0.25, 0.25)))
#: Pieces that a task ranks at once, on average.
RANKED = 500_000


class Encoder:
    """Ids of whole texts: compiled merging by rank where that is exact, else the backtracking encoder.

    Merging any two neighbours that make a token, by the token's id, is the same as merging by the listed pairs if ids follow the order of merges and
    every token's own bytes give that token: neighbours that make a token have then been merged as those bytes by themselves are.
    """

    def __init__(self, path: str, by_rank: bool):
        self.path, self.special = path, vocabulary(path)
        self.ranked = tiktoken.Encoding("corpus", pat_str=PATTERN.pattern, mergeable_ranks=dict(self.special.ids), special_tokens={}) if by_rank else None

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.ranked is None or any(s in text for s in self.special.special):
            return coder(self.path).encode(text)
        try:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # its pattern's stack doesn't take a million spaces in a row
            return coder(self.path).encode(text)


@lru_cache(maxsize=2)
def by_rank(path: str) -> bool:
    """Whether merging by rank is exact for that vocabulary."""
    own = coder(path)
    made = [own.joined[pair] for pair in own.vocabulary.merges]
    return made == sorted(set(made)) and all(own.good[i] for i in own.vocabulary.ids.values())


@lru_cache(maxsize=2)
def encoder(path: str, ranked: bool) -> Encoder:
    """The worker's encoder for that vocabulary."""
    return Encoder(path, ranked)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""
    path = vocabulary_path or default_vocabulary()
    exact = by_rank(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path, exact), END.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = own.encode(text.as_py()) + end
                n = len(ids) // 4
                at = 0
                for k, to in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Steps = dict[int, list[tuple[int, int, int, int]]]


def plan(lengths: dict[int, int], capacity: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> tuple[int, Steps]:
    """How many sequences there are, and for each length the steps (first rank, first sequence, pieces in a sequence, offset)."""
    limits = (capacity, documents, attention)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # used capacities: ranges of sequences (first, how many)
    made, steps = 0, {}

    def score(used: tuple[int, int, int], item: tuple[int, int, int]) -> float:
        if rule == "dot":
            return -sum(w * i / c * (c - u) / c for w, i, u, c in zip(weights, item, used, limits))
        return sum(w * ((c - u - i) / c) ** 2 for w, i, u, c in zip(weights, item, used, limits))

    for length in sorted(lengths, reverse=True):
        item = (length, 1, length * length)
        left, rank, own = lengths[length], 0, []

        def fits(used: tuple[int, int, int]) -> int:
            most = min((c - u) // i for u, i, c in zip(used, item, limits))
            return min(most, 1) if rule == "dot" and used[0] else most  # by `dot`, the one that took a piece falls back

        queue = [(score(used, item), used) for used in open_ if fits(used)]
        heapq.heapify(queue)
        while left:
            if queue:
                used = heapq.heappop(queue)[1]
            else:
                used = (0, 0, 0)
                each = fits(used)
                if not each:
                    raise ValueError(f"a piece of {length} tokens is over the capacities {limits}")
                open_[used] = [(made, -(-left // each))]
                made += -(-left // each)
            each, ranges = fits(used), open_.pop(used)
            while left and ranges:
                first, n = ranges.pop()
                full = min(n, left // each)
                parts = [(first, full, each)] if full else []
                if full < n and left > full * each:
                    parts.append((first + full, 1, left - full * each))
                done = 0
                for begin, many, take in parts:
                    own.append((rank, begin, take, used[0]))
                    rank, left, done = rank + many * take, left - many * take, done + many
                    now = tuple(u + take * i for u, i in zip(used, item))
                    if now not in open_:
                        open_[now] = []
                        if fits(now):
                            heapq.heappush(queue, (score(now, item), now))
                    open_[now].append((begin, many))
                if done < n:
                    ranges.append((first + done, n - done))
            if ranges:
                open_.setdefault(used, []).extend(ranges)
        steps[length] = own
    return made, steps


def ranked(rows: DataFrame, each: int = RANKED) -> DataFrame:
    """`rows` with their rank (from 0) among those of the same length."""
    n = max(1, -(-rows.count() // each))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def packed(parts: DataFrame, capacity: int = 2048, documents: int | None = None, attention: int | None = None, rules: tuple = RULES) -> DataFrame:
    """`parts` (as from `pieces`) with sequence_id and offset.

    `documents` and `attention` bound the pieces of a sequence and the sum of their squared lengths; unset, they are what the capacity implies.
    """
    parts = written(parts, "packing-pieces")
    lengths = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    limits = (capacity, documents or capacity, attention or capacity * capacity)
    steps = min((plan(lengths, *limits, *rule) for rule in rules), key=lambda x: x[0])[1]
    columns = {length: tuple(np.array(c, np.int64) for c in zip(*own)) for length, own in steps.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, begin, take, used = columns[int(n)]
                step = np.searchsorted(first, rank[at], side="right") - 1
                k = rank[at] - first[step]
                sequence[at] = begin[step] + k // take[step]
                offset[at] = used[step] + k % take[step] * n
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = parts.schema["doc_id"].dataType.simpleString()
    order = ranked(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return order.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
