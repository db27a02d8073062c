"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits over 3-word shingles (ASCII-lower-cased words between ASCII white space, repeats included); a
bit is set if it is set in over half of the shingles' XXH64 values (seed 42). Fewer than three words: the whole
sequence is the one shingle; no word: fingerprint zero.

Links: fingerprints at `radius` or fewer differing bits. The bits are dealt into m partitions, each taking bits that
go together in the corpus (counts over all distinct fingerprints). If the thresholds t_i of the partitions add up to
radius - m + 1, a linked pair differs by at most t_i in some partition i; -1 leaves a partition out. A dynamic
programme over the partitions allocates unequal thresholds at the least estimated cost: probes plus candidates, the
latter from the Poisson-binomial distribution of the differing bits. Every distinct fingerprint is filed under its
bits in each partition; the larger of two fingerprints probes all values within t_i there, and the candidates are
verified by their whole distance in the join. Equal fingerprints are one class, so groups of copies aren't expanded.

Groups by content (`similar`, `keep_one`) take fingerprints over each text's distinct words instead, which stay near where shingles
of five words are shared, at a wider radius; and a candidate pair is a link if the sets of five-word shingles agree by 0.8 (Jaccard)
or more. Texts of equal words are one class. So that a large group of near copies isn't expanded, each class first meets the first
one, in a random order, of its own buckets, four times in other orders; after that only candidates of different components are
verified, all of them. Candidates whose sketches already tell that they agree by less are left out first, which loses none: a sketch holds the parity
of the shingles in each of SKETCH cells, so two sketches differ in at most as many cells as the sets in shingles, and sets of a and b shingles that
agree by J differ in no more than (a + b)(1 - J) / (1 + J).

Null texts are empty. Rows without a doc_id are left out. A doc_id that repeats gives a row for each of its rows. Empty tables give
no rows. Texts of any length count whole; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW, components, spread_join, table, written

#: Classes of texts that are sent to all tasks at most.
FEW = 20_000
#: Cells of a sketch, in longs of 64, and the columns that hold them with the number of shingles.
SKETCH = 256
PROFILE = ["n", *(f"s{k}" for k in range(SKETCH // 64))]
#: What a candidate costs against a probe, and where it is only compared within the join, as nearly all are by their sketches.
CANDIDATE, COMPARED = 2.0, 0.1


def fingerprint(text: str | None) -> int:
    """The text's fingerprint, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, glue = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(words, words[1:], words[2:]) if len(words) >= 3 else [words]
    return majority(np.fromiter((digest(glue(s), 42) for s in shingles), np.uint64))


def majority(values: np.ndarray) -> int:
    """The bits set in over half of the values."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        some = values[at : at + (1 << 14)]
        bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def together(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j set; summed by Spark in 4097 cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["cell", "n"])

    cells = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(4097, np.int64)
    for r in cells:
        out[r.cell] = r.n
    return int(out[-1]), out[:-1].reshape(64, 64)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deals the 64 bits into m parts of nearly equal size; each takes, greedily, the bit most correlated with its own."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    link = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        part = [min(left, key=lambda b: (-link[b, list(left)].sum(), b))]
        left.remove(part[0])
        while len(part) < size:
            best = min(left, key=lambda b: (-link[b, part].mean(), b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def allocate(n: int, both: np.ndarray, radius: int = 3, candidate: float = CANDIDATE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, at the least estimated cost over 1 to radius + 1 partitions."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 2):
        parts = partitions(n, both, m)
        cost = []
        for part in parts:
            reach = np.zeros(radius + 1)
            reach[0] = 1.0
            for b in part:  # Poisson-binomial distribution of the differing bits, up to the radius
                reach[1:] = reach[1:] * (1 - differ[b]) + reach[:-1] * differ[b]
                reach[0] *= 1 - differ[b]
            probes = np.cumsum([comb(len(part), t) for t in range(radius + 1)])
            cost.append([0.0, *(n * (1.0 + probes) + candidate * n * n / 2 * np.cumsum(reach))])
        # table[s]: least cost of the parts so far whose thresholds, each raised by one, add up to s
        total = radius - m + 1 + m
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            grown: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in table.items():
                for t in range(min(radius + 1, total - s) + 1):
                    if s + t not in grown or c + row[t] < grown[s + t][0]:
                        grown[s + t] = (c + row[t], [*ts, t - 1])
            table = grown
        if best is None or table[total][0] < best[0]:
            best = (table[total][0], [(part, t) for part, t in zip(parts, table[total][1]) if t >= 0])
    return best[1]


def keys(classes: DataFrame, plan: list[tuple[list[int], int]], probe: bool, also: list[str] = []) -> DataFrame:
    """part, key, fp and the columns `also` (longs): where each fingerprint is filed, or with `probe` where it looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                fp = np.asarray(rows.column("fp"))
                for k, (part, t) in enumerate(plan):
                    own = fp & np.int64(np.array(sum(1 << b for b in part), np.uint64).view(np.int64))
                    for some in (s for d in range(t + 1 if probe else 1) for s in combinations(part, d)):
                        flip = np.array(sum(1 << b for b in some), np.uint64).view(np.int64)[()]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int8)), pa.array(own ^ flip), *rows.columns], ["part", "key", *rows.schema.names])

    return classes.select("fp", *also).mapInArrow(run, "part byte, key long, fp long" + "".join(f", {c} long" for c in also))


def once(plan: list[tuple[list[int], int]]) -> Column:
    """Whether the row's part is the first in which the two fingerprints meet, so that a pair is told once."""
    apart = F.col("fp").bitwiseXOR(F.col("ofp"))
    masks = [int(np.array(sum(1 << b for b in part), np.uint64).view(np.int64)) for part, _ in plan]
    meets = [F.bit_count(apart.bitwiseAND(F.lit(mask).cast("long"))) <= t for mask, (_, t) in zip(masks, plan)]
    first = F.lit(len(plan) - 1)
    for k in reversed(range(len(plan))):
        first = F.when(meets[k], k).otherwise(first)
    return F.col("part") == first


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """a < b: the distinct fingerprints of `classes(fp)` that differ in at most `radius` bits."""
    plan = allocate(*together(classes), radius)
    filed = keys(classes, plan, probe=False).withColumnRenamed("fp", "a")
    looks = keys(classes, plan, probe=True).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return filed.join(looks, ["part", "key"]).where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id reachable over linked fingerprints."""
    rows = written(fingerprints(docs), "simhash-rows", NARROW)
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes", NARROW)
    groups = written(components(links(classes, radius), "simhash-links").withColumnsRenamed({"node": "fp"}), "simhash-groups", NARROW)
    lead = classes.join(groups, "fp").groupBy("component").agg(F.min("first").alias("lead"))
    named = groups.join(lead, "component").select("fp", "lead")
    named = written(classes.join(named, "fp", "left").select("fp", F.coalesce("lead", "first").alias("component_id")), "simhash-named", NARROW)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; fewer words than `size` are one shingle."""
    some = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 5) >> 32 for x in some), np.uint32))


def sketch(found: np.ndarray) -> np.ndarray:
    """The parity of the hashes in each of SKETCH cells, as signed longs."""
    odd = np.bincount(found % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def profiles(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, fp (over the distinct words), t (hash of all words in order), and the shingles' number and sketch, of every row with a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, whole = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            profile = np.zeros((len(PROFILE), batch.num_rows), np.int64)
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().lower().split()
                whole[i] = xxhash.xxh64_intdigest(b" ".join(words), 7)
                found = shingles(words, size)
                profile[:, i] = [len(found), *sketch(found)]
                if words:
                    fp[i] = majority(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in set(words)), np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(whole.view(np.int64)), *map(pa.array, profile)], ["doc_id", "fp", "t", *PROFILE])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, t long" + "".join(f", {c} long" for c in PROFILE))


def other(columns: list[str]) -> list[Column]:
    """The columns under the names of the other side: o before them."""
    return [F.col(c).alias("o" + c) for c in columns]


def may_agree(least: float) -> Column:
    """Whether the sketches leave it open that the shingles agree by `least`."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col("o" + c))) for c in PROFILE[1:]), F.lit(0))
    return F.greatest(apart, F.abs(F.col("n") - F.col("on"))) <= (F.col("n") + F.col("on")) * F.lit((1 - least) / (1 + least) + 1e-9)


def shingled(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """fp, t and the sorted hashes of the shingles of `classes(fp, t, first)`, from the text of the document `first`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for text, t in zip(batch.column("text"), batch.column("t").to_pylist()):
                words = (text.as_py() or "").encode().lower().split()
                keep.append(int(np.array(t, np.int64).view(np.uint64)) == xxhash.xxh64_intdigest(b" ".join(words), 7))
                out.append(shingles(words, size).tobytes() if keep[-1] else b"")
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("t"), pa.array(out, pa.binary())], ["fp", "t", "shingles"]).filter(pa.array(keep, pa.bool_()))

    wanted = written(classes, "simhash-wanted", NARROW)
    few = wanted.limit(FEW + 1).count() <= FEW
    texts = docs.select(F.col("doc_id").alias("first"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(wanted) if few else wanted, "first").select("fp", "t", "text")
    return found.mapInArrow(run, "fp long, t long, shingles binary").dropDuplicates(["fp", "t"])


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """The `pairs(fp, t, ofp, ot)` of classes whose sets of shingles agree by `least` or more."""
    pairs = written(pairs, "simhash-pairs", NARROW)
    ends = pairs.select("fp", "t").unionByName(pairs.select(F.col("ofp").alias("fp"), F.col("ot").alias("t"))).distinct()
    sets = written(shingled(docs, classes.join(ends, ["fp", "t"]).select("fp", "t", "first"), size), "simhash-shingles", NARROW)
    others = sets.withColumnsRenamed({"fp": "ofp", "t": "ot", "shingles": "others"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles"), batch.column("others")):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(shared >= least * (len(a) + len(b) - shared))
            yield batch.select(["fp", "t", "ofp", "ot"]).filter(pa.array(keep, pa.bool_()))

    both = spread_join(pairs.join(sets, ["fp", "t"]), others, ["ofp", "ot"], pairs, ["fp", "t"])
    return written(both.select("fp", "t", "ofp", "ot", "shingles", "others").mapInArrow(run, "fp long, t long, ofp long, ot long"), "simhash-verified", NARROW)


def node(fp: str, t: str) -> Column:
    """A class as one value."""
    return F.concat(F.hex(F.col(fp)), F.lit(":"), F.hex(F.col(t)))


def similar(docs: DataFrame, radius: int = 8, size: int = 5, least: float = 0.8, rounds: int = 4) -> DataFrame:
    """doc_id and lead of every row with a doc_id: the smallest doc_id of its group of texts linked by their shingles."""
    rows = written(profiles(docs, size), "simhash-profiles", NARROW)
    classes = written(rows.groupBy("fp", "t").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in PROFILE]), "simhash-texts", NARROW)
    plan = allocate(*together(classes), radius, COMPARED)
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("ofp"))) <= radius) & ((F.col("fp") != F.col("ofp")) | (F.col("t") != F.col("ot")))
    looks = written(keys(classes, plan, False, ["t"]), "simhash-looks", NARROW)
    links = None
    for k in range(rounds):
        order = F.xxhash64("fp", "t", F.lit(k))
        first = looks.groupBy("part", "key").agg(F.min(F.struct(order.alias("order"), *other(["fp", "t"]))).alias("x"))
        met = spread_join(looks, first, ["part", "key"], looks, ["fp", "t"]).select("fp", "t", "x.*").where(near)
        best = met.groupBy("fp", "t").agg(F.min(F.struct("order", "ofp", "ot")).alias("x")).select("fp", "t", "x.ofp", "x.ot")
        found = verified(docs, classes, best, size, least)
        links = found if links is None else links.unionByName(found)
    edges = lambda links: links.select(node("fp", "t").alias("a"), node("ofp", "ot").alias("b"))
    groups = components(edges(links), "simhash-stars").withColumn("c", F.xxhash64("component"))
    known = written(classes.withColumn("node", node("fp", "t")).join(groups, "node", "left").select("fp", "t", *PROFILE, F.coalesce("c", F.xxhash64("node")).alias("c")), "simhash-known", NARROW)
    filed = keys(known, plan, False, ["t", "c", *PROFILE]).select("part", "key", *other(["fp", "t", "c", *PROFILE]))
    ordered = (F.col("c") > F.col("oc")) & near & may_agree(least)
    probes = keys(known, plan, True, ["t", "c", *PROFILE])
    rest = spread_join(probes, filed, ["part", "key"], looks, ["fp", "t"]).where(ordered & once(plan))
    # both orders are looked at by both sides, so one is enough
    links = links.unionByName(verified(docs, classes, rest.select("fp", "t", "ofp", "ot"), size, least))
    groups = components(edges(links), "simhash-links")
    named = classes.withColumn("node", node("fp", "t")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = named.groupBy("component").agg(F.min("first").alias("lead"))
    named = written(spread_join(written(named.select("fp", "t", "component"), "simhash-classed", NARROW), lead, ["component"], named.select("component"), ["fp", "t"]).select("fp", "t", "lead"), "simhash-leads", NARROW)
    return spread_join(rows, named, ["fp", "t"], rows, ["doc_id"]).select("doc_id", "lead")


def keep_one(docs: DataFrame, radius: int = 8, size: int = 5, least: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of `similar` texts: that of the smallest doc_id.

    Rows without a doc_id stay; rows of one doc_id stay or go together, and go only if each has an earlier one in its group.
    """
    own = docs.columns
    found = similar(docs, radius, size, least).groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("lead")).alias("later"))
    return docs.join(found.where("later").select("doc_id"), "doc_id", "left_anti").select(own)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
