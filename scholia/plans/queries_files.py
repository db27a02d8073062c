"""Queries over files: index documents and states written and read back, sources of quizzes, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import store
from ..session import scratch
from ..sources import blocks as B
from ..sources import documents as D
from ..streaming.state import save_sessions
from .registry import query
from .relations import EVALUATED, NODES, STRIP, nodes, table, turns


@query(f"WITH {NODES} SELECT doc_id, count(*) AS n_nodes, 'en' AS language FROM nodes WHERE kind <> 'paragraph' GROUP BY doc_id")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index documents written as JSON lines and read back."""
    trees = D.nested(nodes(spark, sf_dir).where("kind <> 'paragraph'"), 2)
    source = F.struct(F.lit("md").alias("type"), F.concat("doc_id", F.lit(".md")).alias("filename"), F.lit("en").alias("language"))
    path = scratch(spark, "indexes")
    D.write_indexes(trees.withColumns({"source": source, "metadata": F.struct(F.lit("now").alias("generated_at"))}), path)
    rows, _ = D.read_indexes(spark, path, lines=True)
    return rows.select("doc_id", F.regexp_count("tree", F.lit('"node":')).cast("long").alias("n_nodes"), F.col("source.language").alias("language"))


@query(f"""WITH {EVALUATED} SELECT session, node, count(*) AS attempts, count(*) FILTER (intervention <> 'advance') AS failed_attempts, arg_max(status, (ts, id)) AS status, string_agg(intervention, ',' ORDER BY ts, id) AS history FROM evaluated GROUP BY session, node""")
def saved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all sessions, saved and loaded (K5)."""
    return save_sessions(E.concept_state(E.attempts(turns(spark, sf_dir))), scratch(spark, "sessions"))


@query(f"""WITH f AS (SELECT doc_id, ['txt', 'MD', 'json', 'doc', 'markdown'][doc_id % 5 + 1] AS ext, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS value FROM documents), s AS (SELECT *, {STRIP('value')} AS t, {STRIP("replace(" + STRIP('value') + ", chr(10), ' ')")} AS flat FROM f)
SELECT doc_id, CASE WHEN ext = 'json' THEN 'index' WHEN ext <> 'doc' THEN 'text' END AS kind, CASE WHEN ext NOT IN ('json', 'doc') AND t <> '' THEN CASE WHEN length(flat) <= 240 THEN flat ELSE substr(flat, 1, 239) || '…' END END AS excerpt,
  CASE WHEN ext = 'doc' THEN 'unsupported extension' WHEN ext = 'json' THEN CASE WHEN doc_id % 2 = 0 THEN 'no node id' END WHEN coalesce(t, '') = '' THEN 'empty text' END AS error FROM s""")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of quizzes by extension, with excerpts and errors."""
    k = F.col("doc_id")
    path = F.concat(F.lit("in/"), k, F.lit("."), F.element_at(F.array(*map(F.lit, ["txt", "MD", "json", "doc", "markdown"])), (k % 5 + 1).cast("int")))
    kind, excerpt, error = D.text_or_index(path, F.when(k % 10 == 0, " ").otherwise(F.col("text")), F.when(k % 2 == 1, "n1"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), excerpt.alias("excerpt"), error.alias("error"))


@query(f"""WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN '' ELSE coalesce({STRIP('text')}, '') END AS text FROM conversations)
SELECT conv_id AS doc_id, turn AS ord, text, (turn * 2.5)::DOUBLE AS lo, (turn * 2.5 + 2)::DOUBLE AS hi, NULL AS error FROM s WHERE text <> ''
UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, 'no speech' FROM s GROUP BY conv_id HAVING max(trim(text)) = ''""")
def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts' segments as blocks, and documents without speech."""
    t = F.col("turn").cast("double") * 2.5
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg"), t.alias("start"), (t + 2).alias("end"), F.when(F.col("conv_id") % 4 == 0, " ").otherwise(F.col("text")).alias("text"))
    blocks, silent = B.utterances(segments)
    return blocks.drop("kind").unionByName(silent, allowMissingColumns=True)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def material_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its primary key; the limit is the feature."""
    return store.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)
