"""The relational store: lookups, patches, latest rows, upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def latest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The newest row of each key: a grouped maximum, so hot keys are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(when, tie)).alias("_x")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_x.*")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """`rows` with the fields of `patch` that aren't null."""
    fields = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return rows.join(p, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def deleted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """`rows` without those that `keys` names (id and owner)."""
    return rows.join(keys, on, "left_anti")


def page(rows: DataFrame, order: str, skip: int, limit: int) -> DataFrame:
    """Rows skip to skip + limit in total order."""
    return rows.orderBy(order).offset(skip).limit(limit)


def upload_path(group: Column, subject: Column, name: Column) -> Column:
    """Where an upload is kept."""
    return F.concat(F.lit("uploads/group_"), group.cast("string"), F.lit("/subject_"), subject.cast("string"), F.lit("/"), F.replace(name, F.lit(" "), F.lit("_")))


def absent(rows: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Rows to seed: those not present yet."""
    return rows.join(present, on, "left_anti")


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a primary key, by a filter that the scan takes; none if it's missing."""
    return rows.where(F.col(key) == value).limit(1)


def of_types(artifacts: DataFrame, wanted: list[str]) -> DataFrame:
    """Artifacts whose type is one of those wanted."""
    return artifacts.where(F.col("artifact_type").isin(wanted))


def newest_first(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """`rows` with their place within the key, the newest first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), tie)).cast("long"))


def annotate(path: str, edits: DataFrame, buckets: int = 16) -> DataFrame:
    """Merges edits(material, node, html, at, seq) into the annotations at `path`, and reads what stands.

    The last edit of a node counts, by `at`, then `seq`; an empty or null html deletes. Deletions are kept as such, so that an older edit that comes
    later doesn't bring the node back. Only the buckets of materials that the edits touch are rewritten, from a table written before.
    """
    spark = edits.sparkSession
    rows = edits.select("material", "node", "html", "at", "seq").withColumn("bucket", F.pmod(F.xxhash64("material"), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.schema(rows.schema).parquet(path)
        touched = rows.select("bucket").distinct()
        rows = rows.unionByName(old.join(F.broadcast(touched), "bucket", "left_semi"))  # at most `buckets` rows
    except AnalysisException:  # nothing there yet
        pass
    merged = stored(latest(rows, ["material", "node", "bucket"], "at", "seq"), "annotations")
    merged.select("material", "node", "html", "at", "seq", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return annotations(spark.read.schema(merged.schema).parquet(path))


def annotations(rows: DataFrame) -> DataFrame:
    """Each material's map of nodes to their html, by node."""
    standing = rows.where("html <> ''").groupBy("material").agg(F.array_sort(F.collect_list(F.struct("node", "html"))).alias("all"))
    return standing.select("material", F.map_from_entries("all").alias("html"))
