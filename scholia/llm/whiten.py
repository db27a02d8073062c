"""Whitening of embeddings from an exact scatter, by residue numbers.

Entries c become integers x = floor(1024 c) + 100000. One pass sums each dimension exactly. A second centres the integers by
the floor of each mean and multiplies them per task, modulo several primes below 2^20: residues are small enough that a product
of matrices in doubles is exact. The tasks' products are added modulo the primes in two steps of grouping; the Chinese remainder
theorem then gives the exact scatter, as enough primes are taken for n times the square of the largest centred entry. What is left
of the centring (less than one unit for each dimension) is taken off in integers, so the covariance is rounded only once.
Its eigenvectors are those of `numpy.linalg.eigh` in doubles, each with its largest entry positive.

Vectors that are null, empty or hold null or non-finite entries take no part, nor do those with an entry of 2^52 or more (its x
has no room) or of another length than most have (ties: the longer). Rows that repeat count each. A null id is an id. Components of
no variance have a null `whitened`, and where no dimension varies, a null `explained`. No usable vector: no rows.
`deviation` is exact up to 38 digits, and null beyond; the query's, as a long, beyond its range. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, LIFT = 1024, 100_000
#: Entries below this in size have an exact x.
MOST = 2.0**52
#: Residues are below 2^20 / 2 in size, so a block of this many rows has products below 2^53.
BLOCK = 4096
#: Rows of the scatter that travel together, and the groups of the first of two additions.
BAND, SALTS = 64, 32


@dataclass
class Model:
    """n vectors of d entries: their mean (shift + rest / n), the components by falling variance, the trace."""

    n: int
    d: int
    shift: np.ndarray
    rest: np.ndarray
    most: int
    variances: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components with a variance."""
        return int((self.variances > self.trace * self.d * 2.0**-52).sum())


def vectors(rows: DataFrame, id: str, column: str) -> DataFrame:
    """id and v (array of doubles) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return rows.select(F.col(id).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)


def integers(column: pa.Array) -> Iterator[np.ndarray]:
    """x of the vectors of a batch, a matrix for each length."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.floor(np.asarray(column.flatten()) * SCALE).astype(np.int64) + LIFT
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        yield flat[begin[sizes == d][:, None] + np.arange(d)]


def sums(rows: DataFrame) -> list:
    """d, dimension j, n, the exact sum and the least and largest x, of the length that most vectors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for x in integers(batch.column("v")):
                own = [len(x), (x >> 31).sum(0), (x & (2**31 - 1)).sum(0), x.min(0), x.max(0)]
                was = found.get(x.shape[1])
                found[x.shape[1]] = own if was is None else [was[0] + own[0], was[1] + own[1], was[2] + own[2], np.minimum(was[3], own[3]), np.maximum(was[4], own[4])]
        for d, (n, high, low, least, most) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), *map(pa.array, (high, low, least, most))], ["d", "j", "n", "high", "low", "least", "most"])

    parts = rows.select("v").mapInArrow(run, "d long, j long, n long, high long, low long, least long, most long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    added = written(parts.groupBy("d", "j").agg(F.sum("n").alias("n"), whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most")), "whiten-sums")
    first = added.where("j = 0").orderBy(F.desc("n"), F.desc("d")).first()
    return added.where(F.col("d") == first.d).orderBy("j").collect() if first else []


def primes(bound: int) -> list[int]:
    """The largest primes below 2^20 whose product is over `bound`."""
    out, product, p = [], 1, 2**20
    while product <= bound:
        p -= 1
        if all(p % q for q in range(2, 1025)):
            out.append(p)
            product *= p
    return out


def scatter(rows: DataFrame, d: int, shift: np.ndarray, bound: int) -> np.ndarray:
    """The exact sum of z z^T, z = x - shift, as Python integers; its entries are below `bound` in size."""
    moduli = primes(2 * bound)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(moduli), d, d), np.int64)
        for batch in batches:
            for x in (m for m in integers(batch.column("v")) if m.shape[1] == d):
                z = x - shift
                for at in range(0, len(z), BLOCK):
                    for k, p in enumerate(moduli):
                        r = z[at : at + BLOCK] % p
                        r = np.where(r > p // 2, r - p, r).astype(np.float64)
                        total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        salt = TaskContext.get().partitionId() % SALTS
        for k in range(len(moduli)):
            bands = range(0, d, BAND)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(bands)), pa.array(list(bands)), pa.array([salt] * len(bands)), pa.array([total[k, b : b + BAND].tobytes() for b in bands], pa.binary())], ["k", "band", "salt", "cells"])

    def add(part: pa.Table) -> pa.Table:
        k = part.column("k")[0].as_py()
        cells = np.zeros(len(part.column("cells")[0].as_py()) // 8, np.int64)
        for c in part.column("cells"):
            cells = (cells + np.frombuffer(c.as_buffer(), np.int64)) % moduli[k]
        return pa.table({"k": [k], "band": [part.column("band")[0].as_py()], "salt": [part.column("salt")[0].as_py()], "cells": pa.array([cells.tobytes()], pa.binary())})

    kind = "k long, band long, salt long, cells binary"
    parts = rows.select("v").mapInArrow(multiply, kind)
    parts = parts.groupBy("k", "band", "salt").applyInArrow(add, kind).groupBy("k", "band").applyInArrow(add, kind)
    residues = np.zeros((len(moduli), d, d), np.int64)
    for r in parts.collect():
        residues[r.k, r.band : r.band + BAND] = np.frombuffer(r.cells, np.int64).reshape(-1, d)
    return remaindered(residues, moduli)


def remaindered(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The integers of least size that have these residues."""
    product = 1
    for p in moduli:
        product *= p
    out = sum(residues[k].astype(object) * (product // p * pow(product // p, -1, p)) for k, p in enumerate(moduli)) % product
    return np.where(out > product // 2, out - product, out)


def fit(rows: DataFrame) -> Model | None:
    """The model of `vectors`; None without any."""
    found = sums(rows)
    if not found:
        return None
    n, d = found[0].n, found[0].d
    total = [int(r.high) * 2**31 + int(r.low) for r in found]
    shift = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    most = max(max(abs(r.most - c), abs(r.least - c)) for r, c in zip(found, shift.tolist()))
    centred = rest.astype(object)
    numerator = n * scatter(rows, d, shift, n * most * most + 1) - np.outer(centred, centred)
    covariance = (numerator / (n * n)).astype(np.float64)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    largest = directions[np.abs(directions).argmax(0), np.arange(d)]
    return Model(n, d, shift, rest, most, values, directions * np.where(largest < 0, -1.0, 1.0), float(sum(numerator.diagonal()) / (n * n)))


def whitened(rows: DataFrame, model: Model, components: int = 8) -> DataFrame:
    """id, deviation and the array w: the first components over their standard deviations, null where there is no variance."""
    k = min(components, model.d)
    ranked = min(k, model.rank)
    base = model.vectors[:, :ranked] / np.sqrt(model.variances[:ranked])
    n, d, shift, rest = model.n, model.d, model.shift, model.rest
    small = d * (n * (model.most + 1)) ** 2 < 2**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            fits = np.diff(np.asarray(v.offsets)) == d
            for x in (m for m in integers(v) if m.shape[1] == d):
                z = x - shift
                w = np.full((len(z), k), np.nan)
                w[:, :ranked] = (z - rest / n) @ base
                far = ((n * (z if small else z.astype(object)) - rest) ** 2).sum(1).tolist()
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), flat)
                far = pa.array([f if f < 10**38 else None for f in far], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(fits)), far, lists], ["id", "deviation", "w"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, deviation decimal(38,0), w array<double>")


def identity_error(white: DataFrame, ranked: int) -> float | None:
    """The largest absolute entry of w's covariance (divisor n) minus the identity; None without a component."""
    at = [(i, j) for i in range(ranked) for j in range(i + 1)]
    if not at:
        return None
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in at]).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(at, found))


def components(rows: DataFrame, id: str = "vec_id", column: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each usable vector and component up to `most`: id, component, n, deviation, whitened, explained, identity_error."""
    spark, kind = rows.sparkSession, rows.schema[id].dataType.simpleString()
    rows = vectors(rows, id, column)
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], f"{id} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    white = written(whitened(rows, model, most), "whiten-rows")
    k = min(most, model.d)
    error = identity_error(white, min(k, model.rank))
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in np.maximum(model.variances[:k], 0.0)])
    each = white.select(F.col("id").alias(id), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
