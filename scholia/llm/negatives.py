"""Hard negatives by product quantisation with stored residual norms.

Entries become integers floor(256 x), and a score is an integer inner product. Vectors are cut into subspaces of two entries; each
has its centroids, from a few rounds of k-means over a bounded sample (the rows of the SAMPLE smallest hashes), and every row keeps
its codes and the norm of what they leave. An anchor's look-up tables give the inner product with a row's centroids, and by Cauchy and
Schwarz the score lies within the anchor's norm times the row's residual norm of it. So only rows whose upper bound reaches the
least score that the lower bounds already guarantee are scored exactly, as integers: five of the anchor's label first, then, for
the window that each positive's score opens, ten of other labels. Nothing is lost by the bounds, whatever the centroids.

Anchors in blocks meet rows in chunks, each pair of them one task's group, dealt out by row number, so no label or id makes a group large; a
chunk sends on no more than the rows that an anchor may return. Windows over these give each anchor's first ones.

Rows without a label, id or vector, or with null or non-finite entries, or an entry of 2^16 or more in size, or of another length than
most have (ties: the longer), take no part. Ties of scores go to the smaller id. Rows that repeat are rows of their own, also as an
anchor's positive. Empty tables, and anchors without positives, give no rows; where no window holds a negative, that positive has none.
Only the three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE, MOST = 256, 2.0**16
#: Entries of a subspace, its centroids, the rows they are fitted on, and the rounds.
WIDTH, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 8192, 6
#: Anchors of a block, and bytes of vectors of a chunk.
ANCHORS, CHUNK = 4096, 16 << 20


def integers(rows: DataFrame, id: str, column: str, label: Column) -> DataFrame:
    """row, id, label and x (32-bit integers) of the rows that take part, written so that row numbers stay."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    rows = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null and size(v) > 0").where(fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.floor(np.asarray(v.values) * SCALE).astype("<i4").tobytes() for v in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    made = rows.mapInArrow(run, "id long, label long, x binary").withColumn("row", F.monotonically_increasing_id())
    made = written(made, "negatives-rows")
    common = made.groupBy(F.length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return made.where(F.length("x") == (common.size if common else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a binary column as rows."""
    parts = [np.frombuffer(x.as_buffer(), "<i4") for x in column]
    return np.stack(parts) if parts else np.zeros((0, 0), np.int32)


def centroids(rows: DataFrame) -> np.ndarray:
    """subspace, centroid, entry: k-means in each subspace over the sample; the last subspace is filled up with zeros."""
    sample = rows.orderBy(F.xxhash64("id", "x"), "row").limit(SAMPLE).select("x").toArrow()
    x = padded(matrix(sample.column("x")).astype(np.float64))
    out = np.zeros((x.shape[1], CENTROIDS, WIDTH))
    for m in range(x.shape[1]):
        own, n = np.unique(x[:, m], axis=0, return_counts=True)
        found = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)]
        for _ in range(ROUNDS):
            code = nearest(own, found)
            weight = np.bincount(code, n, len(found))
            for k in range(WIDTH):
                found[:, k] = np.where(weight > 0, np.bincount(code, n * own[:, k], len(found)) / np.maximum(weight, 1), found[:, k])
        out[m] = found[np.arange(CENTROIDS) % len(found)]
    return out


def padded(x: np.ndarray) -> np.ndarray:
    """Rows by subspaces by entries."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point."""
    square = (found**2).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((square - 2 * x[at : at + 8192] @ found.T).argmin(1) for at in range(0, len(x), 8192))])


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """`rows` with their codes and the norm of the residual, rounded up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = padded(matrix(batch.column("x")).astype(np.float64))
            codes = np.stack([nearest(x[:, m], books[m]) for m in range(len(books))], 1).astype(np.uint8)
            left = x - books[np.arange(len(books)), codes]
            norm = np.sqrt((left**2).sum((1, 2))) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], [*batch.schema.names, "codes", "residual"])

    return rows.select("row", "id", "label", "x").mapInArrow(run, "row long, id long, label long, x binary, codes binary, residual double")


class Chunk:
    """Rows of one group with what bounds and scores need."""

    def __init__(self, part: pa.Table, books: np.ndarray):
        self.row, self.id, self.label, self.residual = (np.asarray(part.column(c).combine_chunks()) for c in ("row", "id", "label", "residual"))
        self.x = matrix(part.column("x"))
        self.codes = [np.ascontiguousarray(c).astype(np.intp) for c in np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in part.column("codes")]).T]
        self.books = books

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each row can have."""
        tables = (self.books * padded(anchor[None].astype(np.float64))[0][:, None, :]).sum(2)
        score = np.zeros(len(self.row))
        for t, c in zip(tables, self.codes):
            score += t[c]
        reach = np.sqrt((anchor.astype(np.float64) ** 2).sum()) * self.residual * (1 + 1e-9) + 1e-9 * (1 + np.abs(score))
        return np.ceil(score - reach), np.floor(score + reach)

    def scores(self, some: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact scores."""
        return self.x[some].astype(np.int64) @ anchor.astype(np.int64)


def guaranteed(lower: np.ndarray, n: int) -> float:
    """The least score of the first n, as far as the lower bounds tell."""
    return np.partition(lower, len(lower) - n)[len(lower) - n] if len(lower) >= n else -np.inf


def foremost(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, then id."""
    return np.lexsort((rows, ids, -scores))[:n]


def met(anchors: DataFrame, rows: DataFrame, run, kind: str, blocks: int, chunks: int) -> DataFrame:
    """`run(anchors, rows)` for each block of anchors and chunk of rows, as Arrow tables."""
    of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.select("*", of(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = rows.select("*", of(chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, kind)


def mined(rows: DataFrame, anchors: Column, id: str = "vec_id", column: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each row of `anchors` (a condition on id and label) and each of its first `positives` of the same label: the first `negatives` of
    other labels whose score is between `low` and `high` per cent of the positive's.
    """
    spark = rows.sparkSession
    result = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative long, negative_id long, negative_score long"
    usable = integers(rows, id, column, F.col("label") if label is None else label)
    own = usable.where(anchors).select("row", "id", "label", "x")
    count, n_anchors, size = usable.count(), own.count(), (usable.agg(F.max(F.length("x"))).first()[0] or 0)
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    books = centroids(usable)
    codes = written(encoded(usable, books), "negatives-codes")
    each = max(1, chunk // size)
    chunks = max(-(-count // each), min(spark.sparkContext.defaultParallelism, -(-count // 2048)))
    blocks = -(-n_anchors // block)

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            part, xs = Chunk(right, books), matrix(left.column("x"))
            for row, name, label, x in zip(left.column("row").to_pylist(), left.column("id").to_pylist(), left.column("label").to_pylist(), xs):
                lower, upper = part.bounds(x)
                fit = np.flatnonzero((part.label == label) & (part.row != row))
                fit = fit[upper[fit] >= guaranteed(lower[fit], positives)]
                score = part.scores(fit, x)
                for k in foremost(score, part.id[fit], part.row[fit], positives):
                    found.append((row, name, int(part.row[fit[k]]), int(part.id[fit[k]]), int(score[k])))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 5, names=["anchor", "anchor_id", "positive", "positive_id", "positive_score"])

    pairs = met(own, codes, same, "anchor long, anchor_id long, positive long, positive_id long, positive_score long", blocks, chunks)
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    several = pairs.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    several = several.select(F.col("anchor").alias("row"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"))
    asked = written(own.join(several, "row"), "negatives-asked")

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            part, xs = Chunk(right, books), matrix(left.column("x"))
            for r, x in zip(left.drop(["x"]).to_pylist(), xs):
                lower, upper = part.bounds(x)
                foreign = part.label != r["label"]
                for place, (name, p) in enumerate(zip(r["positive_id"], r["positive_score"]), 1):
                    if p < 0:
                        continue  # the window's ends are the wrong way round
                    fit = np.flatnonzero(foreign & (100 * upper >= low * p) & (100 * lower <= high * p))
                    sure = fit[(100 * lower[fit] >= low * p) & (100 * upper[fit] <= high * p)]
                    fit = fit[upper[fit] >= guaranteed(lower[sure], negatives)]
                    score = part.scores(fit, x)
                    inside = (low * p <= 100 * score) & (100 * score <= high * p)
                    fit, score = fit[inside], score[inside]
                    for k in foremost(score, part.id[fit], part.row[fit], negatives):
                        found.append((r["row"], r["id"], place, name, p, int(part.row[fit[k]]), int(part.id[fit[k]]), int(score[k])))
        columns = list(zip(*found)) if found else [[]] * 8
        return pa.table([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative", "negative_id", "negative_score"])

    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = met(asked, codes, other, result, blocks, chunks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
