"""Index documents: reading JSON leniently and writing trees back as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excerpt, stripped

HEADER = "doc_id string, source struct<type:string,filename:string,language:string>, metadata struct<generated_at:string,agent_version:string,warnings:array<string>>, tree string"


def read_indexes(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid index documents below the path, and what isn't one (file, warning): a document a file, or a line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = raw.withColumn("x", F.from_json("value", HEADER))
    good = F.coalesce(F.col("x.doc_id").isNotNull() & F.col("x.tree").isNotNull(), F.lit(False))
    return rows.where(good).select("file", "x.*"), rows.where(~good).select("file", F.lit("not an index document").alias("warning"))


def nested(nodes: DataFrame, levels: int) -> DataFrame:
    """doc_id and the tree as nested JSON, folded from the deepest of `levels` levels up."""
    rows = nodes.select("doc_id", "node_id", "parent_id", "child_ord", (F.size("path") - 1).alias("level"), "kind", "label", "text").withColumn("children", F.lit(None).cast("string"))
    out = rows.where(F.col("level") == levels)
    for level in range(levels - 1, -2, -1):
        body = F.concat(F.lit('{"node":'), F.to_json(F.struct("node_id", "kind", "label", "text")), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        folded = out.withColumn("json", body)
        if level < 0:
            return folded.select("doc_id", F.col("json").alias("tree"))
        up = folded.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_ord", "json"))), lambda s: s["json"]), ",").alias("children"))
        out = rows.where(F.col("level") == level).drop("children").join(up, ["doc_id", "node_id"], "left")
    return out


def write_indexes(indexes: DataFrame, path: str) -> None:
    """One JSON line for each index document."""
    indexes.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def text_or_index(path: Column, value: Column, node: Column) -> tuple[Column, Column, Column]:
    """kind (text, index or null), excerpt and error of a quiz's source file: texts need content, indexes a node id."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.when(extension.isin("txt", "md", "markdown"), "text").when(extension == "json", "index")
    blank = F.coalesce(stripped(value), F.lit("")) == ""
    error = F.when(kind.isNull(), "unsupported extension").when((kind == "text") & blank, "empty text").when((kind == "index") & (F.coalesce(node, F.lit("")) == ""), "no node id")
    return kind, F.when((kind == "text") & ~blank, excerpt(stripped(value))), error
