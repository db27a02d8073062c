"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logged conversation that is a prefix of a longer one is an earlier snapshot of it. A running exclusive-or of two
64-bit hashes of (position, role, text) identifies every prefix of every conversation; conversations whose whole hash
is a proper prefix of another are left out by an anti-join, and of equal ones the smallest conv_id stays. The rest are
rendered turn by turn.

Turns are ordered by turn (null first), then role and text; repeated equal rows of a conversation count once. A null
role is `unknown`, a null text empty. Texts of any length count whole; a conversation
is rendered as one value. Rows without a conv_id are left out. An empty table gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Marks around a turn of the rendered text (fixed values).
BEGIN, END = "<|im_start|>", "<|im_end|>"
_PREFIX = ["n", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, the position n, whether it is the last, and the hashes h1 and h2 of the prefix up to it."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.row_number().over(order).cast("long").alias("n"), F.lead(F.lit(False), 1, True).over(order).alias("last"))
    running = [F.bit_xor(F.xxhash64("n", "role", "text", F.lit(k))).over(so_far).alias(f"h{k}") for k in (1, 2)]
    return rows.select("conv_id", "turn", "role", "text", "n", "last", *running)


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id of the conversations that no longer one begins with, of equal ones the smallest."""
    whole = rows.where("last").groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"))
    begun = rows.where("not last").select(*_PREFIX).distinct()
    return whole.join(begun, _PREFIX, "left_anti").select("conv_id")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation."""
    rows = turns(conversations)
    text = F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    kept = rows.join(maximal(rows), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("n", text.alias("text")))).alias("turns"))
    return kept.select("conv_id", "n_turns", F.array_join(F.col("turns.text"), "").alias("rendered"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


OP4_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('{BEGIN}' || role || chr(10) || text || '{END}' || chr(10), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (SELECT n, s, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY n, s)
SELECT conv_id, n AS n_turns, s AS rendered FROM whole
WHERE s NOT IN (SELECT s FROM p WHERE pos < n)
"""
