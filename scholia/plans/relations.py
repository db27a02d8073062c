"""Derived relations that queries start from, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each region: nations are chapters, customers sections, orders paragraphs (some blank)."""
    t = lambda n: table(spark, sf_dir, n)
    arr = lambda *c: F.array(*[x.cast("string") for x in c])
    keys = lambda *c: F.array(*[F.col(x).cast("long") for x in c])
    r = t("region").withColumn("doc", F.concat(F.lit("d"), "r_regionkey")).withColumn("rn", F.concat(F.lit("r"), "r_regionkey"))
    n = t("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nn", F.concat(F.lit("n"), "n_nationkey"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("cn", F.concat(F.lit("c"), "c_custkey"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("on", F.concat(F.lit("o"), "o_orderkey"))
    none = F.lit(None).cast("string")
    text = F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus"))
    cut = lambda df, node, parent, order, kind, label, text, path, key: df.select(F.col("doc").alias("doc_id"), node.alias("node_id"), parent.alias("parent_id"), F.col(order).cast("long").alias("child_ord"), F.lit(kind).alias("kind"), label.alias("label"), text.alias("text"), path.alias("path"), key.alias("sort_key"))
    col = F.col
    return (
        cut(r, col("rn"), none, "r_regionkey", "root", col("r_name"), none, arr(col("rn")), keys("r_regionkey"))
        .unionByName(cut(n, col("nn"), col("rn"), "n_nationkey", "chapter", col("n_name"), none, arr(col("rn"), col("nn")), keys("r_regionkey", "n_nationkey")))
        .unionByName(cut(c, col("cn"), col("nn"), "c_custkey", "section", col("c_name"), none, arr(col("rn"), col("nn"), col("cn")), keys("r_regionkey", "n_nationkey", "c_custkey")))
        .unionByName(cut(o, col("on"), col("cn"), "o_orderkey", "paragraph", none, text, arr(col("rn"), col("nn"), col("cn"), col("on")), keys("r_regionkey", "n_nationkey", "c_custkey", "o_orderkey")))
    )


NODES = """nodes AS (
  SELECT 'd' || r_regionkey AS doc_id, 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey::BIGINT AS child_ord, 'root' AS kind, r_name AS label, NULL AS text, ['r' || r_regionkey] AS path, [r_regionkey::BIGINT] AS sort_key FROM region
  UNION ALL SELECT 'd' || r_regionkey, 'n' || n_nationkey, 'r' || r_regionkey, n_nationkey, 'chapter', n_name, NULL, ['r' || r_regionkey, 'n' || n_nationkey], [r_regionkey, n_nationkey] FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'd' || r_regionkey, 'c' || c_custkey, 'n' || n_nationkey, c_custkey, 'section', c_name, NULL, ['r' || r_regionkey, 'n' || n_nationkey, 'c' || c_custkey], [r_regionkey, n_nationkey, c_custkey] FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT 'd' || r_regionkey, 'o' || o_orderkey, 'c' || c_custkey, o_orderkey, 'paragraph', NULL, CASE WHEN o_orderstatus = 'P' THEN '  ' ELSE o_orderpriority || ' ' || o_orderstatus END, ['r' || r_regionkey, 'n' || n_nationkey, 'c' || c_custkey, 'o' || o_orderkey], [r_regionkey, n_nationkey, c_custkey, o_orderkey]
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
)"""

PATTERN = r"(?s)<h1[^>]*>.*?</h1>|<p>.*?</p>|<li>.*?</li>"
PAGE_BLOCKS = rf"""blocks AS (
  SELECT * FROM (SELECT doc_id, ord, CASE WHEN raw LIKE '<h1%' THEN 'heading' WHEN raw LIKE '<li%' THEN 'list_item' ELSE 'paragraph' END AS kind,
    trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text
  FROM (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{PATTERN}')) AS raw, generate_subscripts(regexp_extract_all(html, '{PATTERN}'), 1) - 1 AS ord FROM pages)) WHERE text <> ''
)"""

STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
TEXT_BLOCKS = rf"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents
), placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, {STRIP('line')} AS text FROM lines
), counted AS (SELECT *, len(regexp_split_to_array(text, '\s+')) AS words FROM placed WHERE text <> ''
), blocks AS (
  SELECT doc_id, ord, CASE WHEN words <= 3 THEN 'heading' WHEN regexp_matches(text, '^[•\-*–▪◦·]') THEN 'list_item' ELSE 'paragraph' END AS kind,
    CASE WHEN words <= 3 THEN words ELSE 0 END AS level, text, lo::BIGINT AS lo, (lo + length(line))::BIGINT AS hi FROM counted
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-question turns from events: session, node, ts, id and a rubric triple from the event's number."""
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % 3 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), (k % 5).alias("node"), "ts", F.col("event_id").alias("id"), pick(["alta", "parziale", "assente"], k), pick(["corretta", "parzialmente_corretta", "errata"], F.floor(k / 3)), pick(["rielaborata", "riportata", "non_valutabile"], F.floor(k / 9)), "event_type", "value").toDF("session", "node", "ts", "id", "c", "k", "e", "event_type", "value")


TURNS = """turns AS (
  SELECT user_id AS session, n % 5 AS node, ts, event_id AS id, ['alta', 'parziale', 'assente'][n % 3 + 1] AS c, ['corretta', 'parzialmente_corretta', 'errata'][(n // 3) % 3 + 1] AS k,
    ['rielaborata', 'riportata', 'non_valutabile'][(n // 9) % 3 + 1] AS e, event_type, value FROM (SELECT *, (props->>'$.k')::INT AS n FROM events)
)"""
EVALUATED = TURNS + """, fails AS (
  SELECT *, coalesce(sum(CASE WHEN c = 'alta' AND k = 'corretta' AND e = 'rielaborata' THEN 0 ELSE 1 END) OVER (PARTITION BY session, node ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failed_before FROM turns
), routed AS (
  SELECT *, failed_before + 1 AS attempt, failed_before >= 1 AS second, CASE WHEN c = 'alta' AND k = 'corretta' AND e = 'rielaborata' THEN 'advance' WHEN failed_before >= 1 THEN 'full_redirect'
    WHEN k <> 'corretta' THEN 'redirect_only' WHEN c <> 'alta' THEN 'hint_plus_redirect' ELSE 'modality_switch' END AS intervention FROM fails
), evaluated AS (SELECT *, CASE intervention WHEN 'advance' THEN 'passed' WHEN 'full_redirect' THEN 'fragile' ELSE 'pending' END AS status FROM routed)"""
