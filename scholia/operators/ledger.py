"""A ledger of requests to models: each is known by a hash of what it asks, asked once, and asked again while its answers fail.

Requests are rows of payloads that Spark batches from blocks; answers come as rows whenever they come, also late, repeated or broken. The
ledger is a join of both, so a run that is repeated asks nothing that has been answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.blocks import overlapping_batches

#: How often a request is asked before what it would give is filled in by rule.
ATTEMPTS = 3


def payloads(blocks: DataFrame, size: int, overlap: int = 0, cut: int | None = None) -> DataFrame:
    """doc_id, batch and payload: blocks(doc_id, ord, id, text) as JSON in batches of `size`, texts cut to `cut` characters."""
    rows = overlapping_batches(blocks, "doc_id", "ord", size, overlap)
    text = F.substring("text", 1, cut) if cut else F.col("text")
    items = F.array_sort(F.collect_list(F.struct("ord", F.struct("id", text.alias("text")).alias("item"))))
    return rows.groupBy("doc_id", "batch").agg(F.to_json(F.transform(items, lambda x: x["item"])).alias("payload"))


def addressed(requests: DataFrame) -> DataFrame:
    """`requests(kind, payload, ...)` with their address: equal requests of a kind have the same."""
    return requests.withColumn("address", F.sha2(F.concat_ws("\n", "kind", "payload"), 256))


def valid(body: Column) -> Column:
    """Whether an answer is a JSON array."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(body)), F.lit("ARRAY")), F.lit(False))


def ledger(requests: DataFrame, answers: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """address, kind, uses, tries, state and answer of each different request.

    `answers(address, attempt, body)`; a null body is a failed call. state: answered (the first valid answer stands), rejected
    (as many failures as attempts, none valid), failed (to be asked again) or open. Answers that repeat an attempt count once; those without a request are left out.
    """
    asked = requests.groupBy("address", "kind").agg(F.count("*").alias("uses"))
    good = valid(F.col("body"))
    got = answers.groupBy("address").agg(F.countDistinct("attempt").alias("tries"), F.min_by(F.when(good, F.col("body")), F.when(good, F.struct("attempt", "body"))).alias("answer"))
    rows = asked.join(got, "address", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    state = F.when(F.col("answer").isNotNull(), "answered").when(F.col("tries") >= attempts, "rejected").when(F.col("tries") > 0, "failed").otherwise("open")
    return rows.select("address", "kind", "uses", "tries", state.alias("state"), "answer")


def due(book: DataFrame) -> DataFrame:
    """What to ask now: address and the number of the attempt."""
    return book.where(F.col("state").isin("open", "failed")).select("address", (F.col("tries") + 1).alias("attempt"))
