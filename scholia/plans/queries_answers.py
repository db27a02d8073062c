"""Queries over answers to items: what was said, which item it answers, and requests to models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_at
from ..operators import evaluate as E
from ..operators import quiz as Q
from ..operators import tree
from ..sources import blocks as B
from .registry import query
from .relations import NODES, PAGE_BLOCKS, STRIP, TURNS, nodes, table, turns


@query("""WITH q AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS found FROM customer), r AS (SELECT o_orderkey AS response_id, o_custkey AS k, o_orderkey % 5 - 1 AS i FROM orders),
a AS (SELECT response_id, k, i, found, found AND i BETWEEN 0 AND 2 AS inside FROM r JOIN q USING (k))
SELECT response_id, CASE WHEN NOT found THEN 'no quiz' WHEN NOT inside THEN 'no item' END AS error, CASE WHEN inside THEN ['flashcard', 'mcq', 'open'][i + 1] END AS assessment_type,
  CASE WHEN inside THEN CASE WHEN k % 2 = 0 THEN 'merged:' || k || '_' || i ELSE 'n' || k END END AS node_id,
  CASE WHEN inside THEN CASE WHEN i = 1 AND k % 4 >= 2 THEN 'no options or correct index' WHEN i = 0 AND k % 3 = 0 THEN 'no expected answer' END END AS refused FROM a""")
def answered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that each response answers, as an assessment item, and whether it can be evaluated."""
    k = F.col("c_custkey")
    item = lambda i, kind: F.struct(F.concat(k, F.lit(f"_{i}")).alias("item_id"), F.lit(kind).alias("item_type"), F.when(k % 2 == 1, F.concat(F.lit("n"), k)).alias("node_id"), F.array(F.lit("a"), F.lit("b")).alias("options"), (k % 4).alias("correct_index"), F.when(k % 3 != 0, "x").alias("expected_answer"))
    quizzes = table(spark, sf_dir, "customer").select(k.alias("material_id"), k.alias("id"), F.when(k % 7 == 0, "index").otherwise("quiz").alias("artifact_type"), F.array(item(0, "f"), item(1, "mcq"), item(2, "qa")).alias("items"))
    responses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("response_id"), F.col("o_custkey").alias("material_id"), F.col("o_custkey").alias("quiz_id"), (F.col("o_orderkey") % 5 - 1).cast("int").alias("item_index"))
    rows = Q.bridged(Q.answered(responses, quizzes).select("response_id", "error", "item.*"))
    refused = F.when(F.col("error").isNull(), Q.gate(F.col("assessment_type"), F.col("node_id"), F.col("options"), F.col("correct_index"), F.col("expected_answer")))
    return rows.select("response_id", "error", "assessment_type", "node_id", refused.alias("refused"))


@query(f"""WITH r AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) FILTER (conv_id % 5 <> 0) AS words, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT id, CASE WHEN id % 3 = 0 THEN 'typed' WHEN id % 4 = 0 THEN 'given' ELSE {STRIP('words')} END AS said, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 4 = 0 THEN 'own' WHEN id % 5 <> 0 THEN 'segments=' || n ELSE '{{}}' END END AS features,
  CASE WHEN id % 3 <> 0 AND id % 4 <> 0 AND id % 5 = 0 THEN 'no transcript' END AS error FROM r""")
def spoken_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts and features given or taken from segments."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("seg"), "text")
    given = F.col("id") % 4 == 0
    responses = c.select("id").distinct().select("id", F.when(F.col("id") % 3 == 0, "text").otherwise("audio").alias("modality"), F.lit("typed").alias("response"), F.when(given, "given").alias("transcript"), F.when(given, "own").alias("features"))
    segments = c.where(F.col("id") % 5 != 0)
    computed = segments.groupBy("id").agg(F.concat(F.lit("segments="), F.count("*")).alias("features"))
    return E.spoken(responses, segments, computed)


@query(f"WITH {TURNS} SELECT id, session, CASE WHEN id % 7 <> 0 THEN CASE WHEN id % 11 = 0 THEN 'boh' ELSE c END END AS c, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN 'no valid judgment' END AS error FROM turns")
def open_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open answers with the judgments that a model gave."""
    rows = turns(spark, sf_dir)
    judgments = rows.where("id % 7 <> 0").select("id", F.when(F.col("id") % 11 == 0, "boh").otherwise(F.col("c")).alias("c"), "k", "e")
    return E.judged_open(rows.select("id", "session"), judgments).select("id", "session", "c", "error")


@query(r"SELECT doc_id, nullif(regexp_extract(substr(text, 1, length(text) // 2), '[^\s]+\z') || regexp_extract(substr(text, length(text) // 2 + 1), '^[^\s]*'), '') AS word FROM documents")
def words_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word in the middle of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", word_at(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("word"))


@query(f"WITH {NODES} SELECT c.doc_id, c.node_id, c.parent_id, c.child_ord, p.kind AS parent_kind, p.label AS parent_label FROM nodes c JOIN nodes p ON c.doc_id = p.doc_id AND c.parent_id = p.node_id")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their parents."""
    return tree.children(nodes(spark, sf_dir))


@query(f"""WITH {PAGE_BLOCKS}, v AS (SELECT page_id AS doc_id, page_id * 37 % 100 - 70 AS y FROM pages)
SELECT doc_id, doc_id AS view_id, coalesce(arg_max(ord, ord) FILTER (ord * 10 <= y + 80), min(ord)) AS heading_id FROM v JOIN blocks USING (doc_id) GROUP BY doc_id""")
def current_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that a reader has reached on each page."""
    pages = table(spark, sf_dir, "pages")
    tops = B.html_blocks(pages).select("doc_id", F.col("ord").alias("heading_id"), (F.col("ord") * 10).alias("top"))
    views = pages.select(F.col("page_id").alias("doc_id"), F.col("page_id").alias("view_id"), (F.col("page_id") * 37 % 100 - 70).alias("y"))
    return tree.current_heading(views, tops)


@query(f"""WITH {PAGE_BLOCKS}, b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // 12 AS batch FROM blocks)
SELECT doc_id, batch, 'Titles in ' || CASE WHEN doc_id % 2 = 0 THEN 'Italian' ELSE 'English' END || ', one for each section, as a JSON array in the same order.' || chr(10) || chr(10) || to_json(list({{'kind': kind, 'text': text}} ORDER BY ord)) AS prompt FROM b GROUP BY doc_id, batch""")
def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for titles, batch by batch."""
    return Q.label_requests(B.html_blocks(table(spark, sf_dir, "pages")), F.when(F.col("doc_id") % 2 == 0, "Italian").otherwise("English"))


@query("""SELECT c_custkey, concat_ws(chr(10) || chr(10), 'Source:' || chr(10) || c_name, 'Question: Why?', 'Outline of the answer, not to be shown: So.', CASE WHEN c_custkey % 2 = 0 THEN 'Key aspects: ["a","b"]' END, 'Answer:' || chr(10) || c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Speech: {}' END) AS prompt FROM customer""")
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is told of each open answer."""
    k = F.col("c_custkey")
    points = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "customer").select("c_custkey", Q.judge_request(F.col("c_name"), F.lit("Why?"), F.lit("So."), points, F.col("c_mktsegment"), F.when(k % 3 == 0, "{}")).alias("prompt"))
