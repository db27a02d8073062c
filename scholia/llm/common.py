"""Shared plumbing: reading tables, the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a local one only where that is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints", f"scholia-{os.getpid()}")
    return where.rstrip("/")


#: Codec for tables of hashes and ids, which hardly compress; its buffers are small where a stage writes many files.
NARROW = "snappy"


_paths: list[str] = []


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has written, and tells how many; results that read them have to be saved before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    n = len(_paths)
    _paths.clear()
    return n


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes after which a batch of rows goes to a Python worker, if Spark's own limit of rows isn't reached before.
BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands rows to Python workers in batches of about BATCH_BYTES; the session's own limit is set again afterwards.

    The executor holds a batch, in buffers doubled as they grow, and so does the worker; 10,000 texts may take any size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Parts that a key with over a PARTS-th of the rows is dealt out to.
PARTS = 64


def spread_join(big: DataFrame, small: DataFrame, on: list[str], keys: DataFrame, by: list[str], how: str = "inner", least: int = 10_000, total: int | None = None) -> DataFrame:
    """Inner or left join of two tables of which `big` may have much of its rows in few keys.

    Keys with over a PARTS-th of the rows of `keys` (big's rows, or a written table with the same keys) and over `least` are
    dealt out by a hash of big's columns `by`, and small's rows of these keys repeated; there are fewer than PARTS such keys.
    `total`: how many rows `keys` has, if that is known.
    """
    often = keys.groupBy(*on).agg(F.count("*").alias("_n"))
    total = keys.count() if total is None else total
    hot = [r for r in often.where(F.col("_n") > max(total // PARTS, least)).drop("_n").collect()] if total > least else []
    if not hot:
        return big.join(small, on, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(hot, keys.select(*on).schema).withColumn("_hot", F.lit(True)))
    salted = big.join(hot, on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(PARTS))).otherwise(0).cast("int")).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = small.join(hot, on, "left").withColumn("_part", F.explode(every)).drop("_hot")
    return salted.join(repeated, [*on, "_part"], how).drop("_part")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected `edges(a, b)` as (node, component), component the smallest node.

    Alternates the large-star and small-star steps (each a groupBy with partial aggregation and a join) until the
    edge set is a forest of stars. Every step's edges are a written table. No edges: no rows. Self-loops and nulls
    are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = written(e, label, NARROW), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(least, "u")
        e = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(e.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label, NARROW)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
