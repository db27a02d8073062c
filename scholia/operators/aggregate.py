"""Cross-document trees from responses of unknown shape: JSON as variants, unfolded level by level.

A response asks for categories within categories that hold references. Each level is one generator over the arrays of the
level above, so the plan has as many as `depth` and nothing is collected; what lies deeper is as if it weren't there. References are
taken where they come first in the tree's order; invented ones go, and categories left without any. References that no
category took hang under a catch-all. Responses that can't be used give a category for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# What a tree may be organised by, and labels.
PRINCIPLES = ["chronological", "topical", "alphabetical", "structural"]
CATCH_ALL, UNNAMED = "Senza categoria", "Categoria "
NO_RATIONALE, FALLBACK = "(no rationale provided)", "Fallback: aggregator LLM unavailable, grouped by source filename."

NODES = ["req_id", "node_id", "parent_id", "level", "kind", "label", "ref_id"]


def kind_of(value: Column, kind: str) -> Column:
    """Whether a variant is a STRING, an OBJECT or an ARRAY."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def text_of(value: Column, path: str) -> Column:
    """A scalar below the variant as stripped text; empty where there is none."""
    return F.trim(F.coalesce(F.try_variant_get(value, path, "string"), F.lit("")))


def parsed(responses: DataFrame) -> DataFrame:
    """req_id, v, and whether it is an object (`usable`) with a list that isn't empty (`planted`)."""
    rows = responses.select("req_id", F.try_parse_json("response").alias("v"))
    tree = F.try_variant_get("v", "$.tree", "array<variant>")
    return rows.withColumn("usable", kind_of(F.col("v"), "OBJECT")).withColumn("items", F.when(F.col("usable"), tree)).withColumn("planted", F.coalesce(F.size("items") > 0, F.lit(False)))


def unfolded(rows: DataFrame, depth: int) -> DataFrame:
    """req_id, at (places from the top, from 1), label and ref_id of every object down to `depth`; ref_id is null for categories."""
    level = rows.where("planted").select("req_id", F.array().cast("array<int>").alias("at"), "items")
    found = None
    for _ in range(depth):
        each = level.select("req_id", "at", F.posexplode("items").alias("place", "v")).where(kind_of(F.col("v"), "OBJECT"))
        each = each.withColumn("at", F.concat("at", F.array(F.col("place") + 1)))
        named = F.when(kind_of(F.try_variant_get("v", "$.ref_id", "variant"), "STRING"), F.try_variant_get("v", "$.ref_id", "string"))
        each = each.withColumn("ref_id", F.when(F.length(named) > 0, named)).withColumn("label", text_of(F.col("v"), "$.label"))
        found = each.select("req_id", "at", "label", "ref_id") if found is None else found.unionByName(each.select("req_id", "at", "label", "ref_id"))
        level = each.where("ref_id is null").select("req_id", "at", F.try_variant_get("v", "$.children", "array<variant>").alias("items"))
    return found


def named(at: Column) -> Column:
    """A node's id from its places."""
    return F.concat(F.lit("agg_"), F.array_join(at.cast("array<string>"), "_"))


def trees(responses: DataFrame, refs: DataFrame, depth: int = 4) -> DataFrame:
    """req_id, node_id, parent_id, level, kind, label, ref_id of the tree of each of `responses(req_id, response)`.

    `refs(req_id, ref_id, ord, source_filename, label)` may be placed; a request's references are one group of a window, split by nothing
    else, as one folder's.
    """
    rows = parsed(responses)
    items = stored(unfolded(rows, depth), "aggregate-items")
    first = Window.partitionBy("req_id", "ref_id").orderBy("at")
    leaves = items.where("ref_id is not null").withColumnRenamed("label", "own").join(refs.select("req_id", "ref_id", "label"), ["req_id", "ref_id"])
    leaves = leaves.withColumn("n", F.row_number().over(first)).where("n = 1")
    leaves = leaves.select("req_id", "at", F.when(F.col("own") != "", F.col("own")).otherwise(F.trim("label")).alias("label"), "ref_id")
    leaves = stored(leaves, "aggregate-leaves")
    above = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda n: F.slice("at", 1, n))
    held = leaves.where(F.size("at") > 1).select("req_id", F.explode(above).alias("at")).distinct()
    groups = items.where("ref_id is null").join(held, ["req_id", "at"], "left_semi")
    groups = groups.select("req_id", "at", F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit(UNNAMED), F.element_at("at", -1))).alias("label"), "ref_id")
    level = F.size("at")
    kind = F.when(F.col("ref_id").isNotNull(), "ref").when(level == 1, "category").otherwise("subcategory")
    parent = F.when(level == 1, "root").otherwise(named(F.slice("at", 1, level - 1)))
    placed = groups.unionByName(leaves).select("req_id", named(F.col("at")).alias("node_id"), parent.alias("parent_id"), level.alias("level"), kind.alias("kind"), "label", "ref_id")

    planted = rows.where("planted").select("req_id")
    missing = refs.join(planted, "req_id", "left_semi").join(leaves.select("req_id", "ref_id"), ["req_id", "ref_id"], "left_anti")
    tops = placed.where("level = 1").groupBy("req_id").agg((F.count("*") + 1).alias("k"))
    missing = missing.join(tops, "req_id", "left").withColumn("under", F.concat(F.lit("root_"), F.coalesce("k", F.lit(1))))
    own = F.row_number().over(Window.partitionBy("req_id").orderBy("ord"))
    none = F.lit(None).cast("string")
    caught = missing.select("req_id", F.concat("under", F.lit("_"), own).alias("node_id"), F.col("under").alias("parent_id"), F.lit(2).alias("level"), F.lit("ref").alias("kind"), F.trim("label").alias("label"), "ref_id")
    catch = missing.select("req_id", F.col("under").alias("node_id")).distinct().select("req_id", "node_id", F.lit("root").alias("parent_id"), F.lit(1).alias("level"), F.lit("category").alias("kind"), F.lit(CATCH_ALL).alias("label"), none.alias("ref_id"))

    sources = by_source(refs.join(planted, "req_id", "left_anti").join(responses.select("req_id"), "req_id", "left_semi"))
    root = responses.select("req_id", F.lit("root").alias("node_id"), none.alias("parent_id"), F.lit(0).alias("level"), F.lit("root").alias("kind"), none.alias("label"), none.alias("ref_id"))
    return root.unionByName(placed).unionByName(catch).unionByName(caught).unionByName(sources)


def by_source(refs: DataFrame) -> DataFrame:
    """Each request's references below a category for each source, in order."""
    none = F.lit(None).cast("string")
    firsts = refs.groupBy("req_id", "source_filename").agg(F.min("ord").alias("first"))
    firsts = firsts.withColumn("i", F.concat(F.lit("agg_"), F.row_number().over(Window.partitionBy("req_id").orderBy("first"))))
    place = F.row_number().over(Window.partitionBy("req_id", "source_filename").orderBy("ord"))
    below = refs.withColumn("j", place).join(firsts, ["req_id", "source_filename"]).select("req_id", F.concat("i", F.lit("_"), "j").alias("node_id"), F.col("i").alias("parent_id"), F.lit(2).alias("level"), F.lit("ref").alias("kind"), F.trim("label").alias("label"), "ref_id")
    stem = F.regexp_replace("source_filename", r"(?<=.)\.[^.]*$", "")
    return firsts.select("req_id", F.col("i").alias("node_id"), F.lit("root").alias("parent_id"), F.lit(1).alias("level"), F.lit("category").alias("kind"), stem.alias("label"), none.alias("ref_id")).unionByName(below)


def headers(responses: DataFrame, refs: DataFrame, depth: int = 4) -> DataFrame:
    """req_id, principle, rationale, n_sources, n_refs, n_dropped (references that the catch-all took) and the warnings."""
    rows = parsed(responses)
    said = F.lower(F.coalesce(F.try_variant_get("v", "$.organizing_principle", "string"), F.lit("topical")))
    known = said.isin(PRINCIPLES)
    counts = refs.groupBy("req_id").agg(F.count("*").alias("n_refs"), F.countDistinct("source_filename").alias("n_sources"))
    found = trees(responses, refs, depth).where(F.col("kind") == "ref").groupBy("req_id").agg(F.count_if(F.col("parent_id").startswith("root_")).alias("n_dropped"))
    rows = rows.join(counts, "req_id", "left").join(found, "req_id", "left").na.fill(0, ["n_refs", "n_sources", "n_dropped"])
    rationale = text_of(F.col("v"), "$.principle_rationale")
    dropped = F.concat(F.lit("aggregator dropped "), "n_dropped", F.lit(f" refs; appended to '{CATCH_ALL}'"))
    warnings = F.array(
        F.when(~F.col("usable"), "aggregator LLM returned non-object response; using fallback"),
        F.when(F.col("usable") & ~known, F.concat(F.lit("unknown organizing_principle '"), said, F.lit("'; defaulting to topical"))),
        F.when(F.col("usable") & ~F.col("planted"), "aggregator returned empty tree; using fallback"),
        F.when(F.col("n_dropped") > 0, dropped),
    )
    return rows.select(
        "req_id",
        F.when(~F.col("planted"), "structural").when(known, said).otherwise("topical").alias("principle"),
        F.when(~F.col("planted"), FALLBACK).when(rationale != "", rationale).otherwise(NO_RATIONALE).alias("rationale"),
        "n_sources",
        "n_refs",
        "n_dropped",
        F.array_compact(warnings).alias("warnings"),
    )
