"""Benchmark decontamination by latent semantic retrieval.

Space. Texts are cut to passages of `BLOCK` words; words are hashed to `TERMS` columns. Every task adds its passages'
term counts, with random signs, into `SKETCH` rows (a sparse random projection of the passages; Spark sums the tasks'
rows), and counts in how many passages a term occurs. Scaling the sketch's columns by the inverse passage frequencies
gives the sketch of the TF-IDF matrix; its singular value decomposition (SKETCH x TERMS, on the driver, of fixed
size) gives the latent space, whose axes are scaled to equal spread. It covers all passages.

Search. Windows of whole blocks, as long as a benchmark segment needs, slide over each text by one block. An inverted index
of each segment's rarest words tells the windows whose words can make up `paraphrase_lcs` of the segment at all (without its
other words a window can't, so none is lost); their latent vectors are compared with the segment's by cosine, and candidates at `cosine` or more are
checked by the longest common subsequence of words: a text holds an item if a segment's words
agree by `least_lcs` or more; or by `paraphrase_lcs` or more if the item's answer (its last sentence) is there too.
Items under `least_words` words are found where all their words stand in a row; those under `least_run` only as whole texts.

Null and empty texts or items match nothing; rows without doc_id or item_id are left out; repeated rows count once.
Texts are searched whole. Empty tables give no rows. Columns other than doc_id, text, item_id and text aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import Words, lcs, mix, scan

TERMS, SKETCH, RANK = 1 << 13, 128, 96
BLOCK = 8
#: Added to each term's inverse passage frequency, so that no term's weight is zero.
FLOOR = 0.1
#: Words of a benchmark segment at most; longer items are searched in several.
SEGMENT = 64
#: Share of a segment's words, beyond those that a window may lack, in the index of its rarest words.
SPARE = 0.1
#: Pairs of words and segments, and windows, that are looked at together.
PAIRS, ROWS = 1 << 21, 1 << 10
#: Benchmark items that one pass over the texts searches for.
ITEMS = 50_000


def sketched(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The sketch of the term counts, the passages with each term, and the number of passages: of a size that doesn't
    depend on the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df, n = np.zeros(SKETCH * TERMS, np.float32), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for w in scan(batch.column("text")):
                if not len(w.hash):
                    continue
                block = w.index() // BLOCK
                passage = np.cumsum(np.concatenate([[0], (block[1:] != block[:-1]) | (w.text[1:] != w.text[:-1])]))
                term = (w.hash & np.uint64(TERMS - 1)).astype(np.int64)
                # a passage's row and sign come from its words, so a rerun task gives the same
                head = mix(np.add.reduceat(w.hash, np.flatnonzero(np.diff(passage, prepend=-1))))
                row, sign = (head >> np.uint64(40)).astype(np.int64) % SKETCH, np.where(head >> np.uint64(63), 1.0, -1.0).astype(np.float32)
                np.add.at(total, row[passage] * TERMS + term, sign[passage])
                df += np.bincount(np.unique(passage * TERMS + term) % TERMS, minlength=TERMS)
                n += int(passage[-1]) + 1
        rows = [total[k * TERMS : (k + 1) * TERMS] for k in range(SKETCH)] + [df.astype(np.float64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH + 1, dtype=np.int32)), pa.array(np.full(SKETCH + 1, n)), pa.array([r.astype(np.float64 if k == SKETCH else np.float32).tobytes() for k, r in enumerate(rows)], pa.binary())], ["row", "n", "x"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.float64 if key[0].as_py() == SKETCH else np.float32
        total, n = np.zeros(TERMS, kind), 0
        for part in parts:
            for x in part.column("x"):
                total += np.frombuffer(x.as_py(), kind)
            n += sum(part.column("n").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["row", "n", "x"])

    def add_some(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(key[:1], parts)

    kind = "row int, n long, x binary"
    # merged in two levels, as every task gives a row of each number
    tasks = docs.select("text").mapInArrow(run, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    merged = tasks.groupBy("row", "part").applyInArrow(add_some, kind).groupBy("row").applyInArrow(add, kind)
    found = {r.row: r for r in merged.collect()}  # SKETCH + 1 rows
    if not found:
        return np.zeros((SKETCH, TERMS)), np.zeros(TERMS), 0
    return np.stack([np.frombuffer(found[k].x, np.float32) for k in range(SKETCH)]).astype(np.float64), np.frombuffer(found[SKETCH].x), found[SKETCH].n


def latent(sketch: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """For each term its inverse passage frequency times its place in the latent space, TERMS x RANK."""
    idf = np.log((n + 1) / (df + 1))
    weight = idf + FLOOR
    _, values, right = np.linalg.svd(sketch * weight, full_matrices=False)
    scale = np.where(values > 1e-9, values[0] / np.maximum(values, 1e-9), 0)[:RANK]
    return (weight[:, None] * (right[:RANK] * scale[:, None]).T).astype(np.float32)


def answer(text: str) -> str:
    """The last sentence, if there are several."""
    parts = [p for p in re.split(r"(?<=[.!?:])\s+|\n", text.strip()) if p.strip()]
    return parts[-1] if len(parts) > 1 else ""


def hashed(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out: list[np.ndarray] = []
    for w in scan(pa.array(texts, pa.string())):
        bounds = w.bounds()
        out += [w.hash[bounds[k] : bounds[k + 1]] for k in range(w.n_texts)]
    return out


class Segments:
    """The searched segments of benchmark items: words, window sizes, latent vectors, and an index of their rarest words."""

    def __init__(self, items: list[tuple[int, str]], least_words: int, least_run: int, least_lcs: float, df: np.ndarray):
        self.item: list[int] = []
        self.words: list[list[int]] = []
        self.answers = {i: h.tolist() for (i, _), h in zip(items, hashed([answer(t) for _, t in items]))}
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words and hash of the run: items
        self.least_run = least_run
        for (i, _), h in zip(items, hashed([t for _, t in items])):
            if 0 < len(h) < least_words:
                self.short.setdefault(len(h), {}).setdefault(int(runs(h, len(h))[0]), []).append(i)
            if len(h) < least_words:
                continue
            for part in np.array_split(h, max(1, -(-len(h) // SEGMENT))):
                self.item.append(i)
                self.words.append(part.tolist())
        self.counts = [Counter(x) for x in self.words]
        self.blocks = np.array([-(-(len(x) + BLOCK - 1) // BLOCK) for x in self.words], np.int64)
        self.needed = np.zeros(len(self.words), np.int64)  # of a segment's indexed words, repeats included, at least
        index: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.counts):
            n = len(self.words[k])
            least, others = -int(-least_lcs * n // 1), n
            for x in sorted(own, key=lambda x: (df[x & (TERMS - 1)], x)):
                if others < least - SPARE * n:
                    break
                index.setdefault(x, []).append((k, own[x]))
                others -= own[x]
            self.needed[k] = max(1, least - others)
        self.keys = np.array(sorted(index), np.uint64)
        pairs = [p for x in sorted(index) for p in index[x]]
        self.ends = np.cumsum([0] + [len(index[x]) for x in sorted(index)])
        self.segment, self.times = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))

    def vectors(self, space: np.ndarray) -> np.ndarray:
        """Unit latent vectors of the segments."""
        out = np.stack([space[np.array(x, np.uint64) & np.uint64(TERMS - 1)].sum(0) for x in self.words]) if self.words else np.zeros((0, RANK), np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words in a row."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n if len(out) else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
        return mix(out)


def short_items(w: Words, segments: Segments) -> Iterator[tuple[int, int]]:
    """Text (within the piece) and item of each short item that stands in the texts word by word."""
    bounds, owner = w.bounds(), w.text - w.first_text
    for n, known in segments.short.items():
        found = runs(w.hash, n)
        for at in np.flatnonzero(np.isin(found, np.array(list(known), np.uint64))).tolist():
            text = int(owner[at])
            whole = bounds[text + 1] - bounds[text] == n
            if owner[at + n - 1] == text and (n >= segments.least_run or whole):
                for i in known[int(found[at])]:
                    yield text, i


def windows(w: Words, segments: Segments) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text (within the piece), first word (within the piece) and segment of the windows with enough of the indexed words."""
    if not len(segments.keys):
        return
    slot = np.minimum(np.searchsorted(segments.keys, w.hash), len(segments.keys) - 1)
    at = np.flatnonzero(segments.keys[slot] == w.hash)
    if not len(at):
        return
    slot, reach, bounds = slot[at], int(segments.blocks.max()), w.bounds()
    blocks = -(-np.diff(bounds) // BLOCK)
    offset = np.concatenate([[0], np.cumsum(blocks + reach)])  # empty blocks keep the windows of texts apart
    text = w.text[at] - w.first_text
    block = offset[text] + (at - bounds[text]) // BLOCK
    size = segments.ends[slot + 1] - segments.ends[slot]
    total, wide, begin = np.cumsum(size), int(offset[-1]) + 2 * reach + 1, 0
    while begin < len(at):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        more = int(np.searchsorted(block, block[end - 1] + reach, side="right"))  # windows that begin here reach so far
        some = size[begin:more]
        pair = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(segments.ends[slot[begin:more]], some)
        code, where = np.unique(segments.segment[pair] * wide + np.repeat(block[begin:more], some), return_inverse=True)
        sums = np.concatenate([[0], np.cumsum(np.bincount(where, weights=segments.times[pair]))])
        own = code // wide
        enough = sums[np.searchsorted(code, code + segments.blocks[own])] - sums[:-1] >= segments.needed[own]
        code, own = code[enough], own[enough]
        # all windows that begin up to a window before; those that the next round sees again are found twice at most
        spread = segments.blocks[own]
        back = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        found = np.unique(np.repeat(code, spread) - back)
        own, place = found // wide, found % wide
        k = np.searchsorted(offset, place, side="right") - 1
        inside = (k < len(blocks)) & (place - offset[np.minimum(k, len(blocks))] < blocks[np.minimum(k, len(blocks) - 1)])
        k, own, place = k[inside], own[inside], place[inside]
        yield k, bounds[k] + (place - offset[k]) * BLOCK, own
        begin = end


def candidates(w: Words, space: np.ndarray, segments: Segments, vectors: np.ndarray, cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """Text (within the piece), first word (within the piece), segment and cosine of each window that comes near."""
    bounds = w.bounds()
    term = np.append((w.hash & np.uint64(TERMS - 1)).astype(np.int64), TERMS)
    space = np.concatenate([space, np.zeros((1, space.shape[1]), space.dtype)])  # the last row: no word
    for text, first, own in windows(w, segments):
        for some in range(0, len(own), ROWS):
            k, lo, seg = text[some : some + ROWS], first[some : some + ROWS], own[some : some + ROWS]
            at = lo[:, None] + np.arange(int(segments.blocks[seg].max()) * BLOCK)
            hi = np.minimum(lo + segments.blocks[seg] * BLOCK, bounds[k + 1])
            window = space[term[np.where(at < hi[:, None], at, len(term) - 1)]].sum(1)
            near = np.einsum("ij,ij->i", window, vectors[seg]) / np.maximum(np.linalg.norm(window, axis=1), 1e-9)
            for i in np.flatnonzero(near >= cosine).tolist():
                yield int(k[i]), int(lo[i]), int(seg[i]), float(near[i])


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.2, least_lcs: float = 0.75, paraphrase_lcs: float = 0.6, least_words: int = 8, least_run: int = 4) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer_found for every text and benchmark item that it holds."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).dropna().dropDuplicates(["item_id"])
    parts = max(1, -(-items.count() // ITEMS))
    sketch, df, n = sketched(docs)
    space = latent(sketch, df, n)
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # about ITEMS rows
        found = _searched(docs, Segments([(r.item_id, r.text) for r in sorted(own)], least_words, least_run, paraphrase_lcs, df), space, cosine, least_lcs, paraphrase_lcs, benchmark.schema["item_id"].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("lcs", "cosine", "answer_found")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.lcs", "x.answer_found")


def _searched(docs: DataFrame, segments: Segments, space: np.ndarray, cosine: float, least_lcs: float, paraphrase_lcs: float, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((space, segments, segments.vectors(space)))  # ITEMS and TERMS bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, segments, vectors = shared.value
        for batch in batches:
            out: dict[tuple[int, int], tuple[float, float, bool]] = {}
            for w in scan(batch.column("text")):
                if not len(w.hash):
                    continue
                bounds = w.bounds()
                for text, i in short_items(w, segments):
                    out[w.first_text + text, i] = (1.0, 1.0, False)
                for text, at, k, near in candidates(w, space, segments, vectors, cosine):
                    words = segments.words[k]
                    lo, hi = max(at - BLOCK, bounds[text]), min(at + int(segments.blocks[k]) * BLOCK + BLOCK, bounds[text + 1])
                    window = w.hash[lo:hi].tolist()
                    if sum(map(segments.counts[k].__getitem__, set(window))) < paraphrase_lcs * len(words):
                        continue
                    share = lcs(words, window) / len(words)
                    if share < paraphrase_lcs:
                        continue
                    said = segments.answers[segments.item[k]]
                    if said:
                        tail = w.hash[lo : min(hi + len(said) + SEGMENT, bounds[text + 1])].tolist()
                        said = lcs(said, tail) >= 0.9 * len(said)
                    if share >= least_lcs or said:
                        key = (w.first_text + text, segments.item[k])
                        out[key] = max(out.get(key, (0.0, 0.0, False)), (share, near, bool(said)))
            rows = pa.array([k[0] for k in out], pa.int64())
            items = pa.array([k[1] for k in out])
            names = ["doc_id", "item_id", "lcs", "cosine", "answer_found"]
            if not out:
                items = pa.array([], batch.column("doc_id").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), items, *[pa.array([v[j] for v in out.values()], t) for j, t in enumerate((pa.float64(), pa.float64(), pa.bool_()))]], names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, lcs double, cosine double, answer_found boolean")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the texts that hold benchmark items."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 6).alias("lcs"), "answer_found")
