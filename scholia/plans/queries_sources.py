"""Queries over sources and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import format_level
from ..operators import tree
from ..sources import blocks as B
from .registry import query
from .relations import PAGE_BLOCKS, TEXT_BLOCKS, table


@query(f"""WITH {PAGE_BLOCKS}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS section,
  coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM blocks
), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ord) - 1 AS within FROM s)
SELECT doc_id, ord, kind, text, lo::BIGINT AS lo, (lo + length(text))::BIGINT AS hi, CASE WHEN section = 0 THEN '0.' || (within + 1) WHEN within = 0 THEN section::VARCHAR ELSE section || '.' || within END AS number FROM n""")
def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's blocks in order, numbered by section, with their range in the page's text."""
    rows = B.html_blocks(table(spark, sf_dir, "pages"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = rows.withColumn("section", F.sum((F.col("kind") == "heading").cast("long")).over(w))
    rows = rows.withColumn("lo", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("ord")) - 1)
    section = format_level(F.col("section"), F.lit(1))
    number = F.when(F.col("section") == 0, F.concat(F.lit("0."), F.col("n") + 1)).when(F.col("n") == 0, section).otherwise(F.concat(section, F.lit("."), format_level(F.col("n"), F.lit(2))))
    return rows.select("doc_id", "ord", "kind", "text", "lo", (F.col("lo") + F.length("text")).alias("hi"), number.alias("number"))


@query(f"WITH {TEXT_BLOCKS} SELECT * FROM blocks")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks with character ranges."""
    return B.text_blocks(table(spark, sf_dir, "documents"))


@query(f"""WITH {TEXT_BLOCKS}, h AS (SELECT doc_id, count(*) AS n, count(*) FILTER (kind = 'heading') AS headings, count(DISTINCT CASE WHEN kind = 'heading' THEN level END) AS levels FROM blocks GROUP BY doc_id)
SELECT doc_id, n, headings, levels, headings > 0 AS as_md, headings >= 3 AND headings / n BETWEEN 0.005 AND 0.25 AS as_pdf, CASE WHEN headings >= 3 AND headings / n BETWEEN 0.005 AND 0.25 THEN 'structured' ELSE 'semantic' END AS branch FROM h""")
def structure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text's layout gives its outline, as markdown and as PDF."""
    head = F.col("kind") == "heading"
    rows = B.text_blocks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(head).alias("headings"), F.countDistinct(F.when(head, F.col("level"))).alias("levels"))
    flag = lambda kind: B.has_structure(F.lit(kind), F.col("headings"), F.lit(0), F.col("n"))
    return rows.select("*", flag("md").alias("as_md"), flag("pdf").alias("as_pdf"), F.when(flag("pdf"), "structured").otherwise("semantic").alias("branch"))


_SPANS = """spans AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey % 30 AS page, l_orderkey AS line, l_linenumber AS span, CASE WHEN l_linenumber = 1 AND l_quantity < 10 THEN (l_quantity::INT % 10) || '. ' ELSE '' END || p_name || ' ' AS text, l_quantity / 4 AS size FROM lineitem JOIN part ON l_partkey = p_partkey
), body AS (SELECT d.doc_id, coalesce(b.body, 11.0) AS body FROM (SELECT DISTINCT doc_id FROM spans) d LEFT JOIN (SELECT doc_id, median(size) AS body FROM spans WHERE page < 20 AND trim(text) <> '' GROUP BY doc_id) b USING (doc_id)
), ln AS (SELECT doc_id, page, line, string_agg(text, '' ORDER BY span, text) AS text, max(size) AS size FROM spans GROUP BY doc_id, page, line
), kinds AS (SELECT ln.*, body, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo,
  CASE WHEN size >= 1.18 * body AND length(text) <= 120 THEN 'heading' WHEN regexp_matches(text, '^[•\\-*–▪◦·]') OR (length(text) >= 3 AND regexp_matches(text, '^([0-9][.)] |\\p{L}\\) )')) THEN 'list_item' ELSE 'paragraph' END AS kind FROM ln JOIN body USING (doc_id))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    mark = F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") < 10), F.concat((F.col("l_quantity").cast("int") % 10).cast("string"), F.lit(". "))).otherwise("")
    return rows.select((F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_orderkey") % 30).alias("page"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("span"), F.concat(mark, "p_name", F.lit(" ")).alias("text"), (F.col("l_quantity") / 4).alias("size"))


@query(f"WITH {_SPANS} SELECT doc_id, page, line, text, size, body, lo, kind FROM kinds")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined to lines, with median body size, kind and place on the page."""
    return B.pdf_lines(_spans(spark, sf_dir)).select("doc_id", "page", "line", "text", "size", "body", "lo", "kind")


@query(f"""WITH {_SPANS}, ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS level FROM (SELECT DISTINCT doc_id, round(size, 1) AS s FROM kinds WHERE kind = 'heading') QUALIFY level <= 3)
SELECT k.doc_id, page, line, level FROM kinds k LEFT JOIN ranked r ON k.doc_id = r.doc_id AND round(size, 1) = s WHERE kind = 'heading'""")
def pdf_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading sizes as levels; beyond the third they are demoted."""
    heads = B.pdf_lines(_spans(spark, sf_dir)).where("kind = 'heading'").select("doc_id", "page", "line", "size")
    return tree.size_levels(heads).select("doc_id", "page", "line", "level")


@query(f"""WITH {_SPANS}, top AS (SELECT doc_id, page, max(size) AS most FROM spans GROUP BY doc_id, page), t AS (SELECT s.doc_id, s.page, min((line, span)) AS first FROM spans s JOIN top USING (doc_id, page) WHERE size >= most - 0.5 GROUP BY s.doc_id, s.page)
SELECT doc_id, page, first[1] AS line, first[2] AS span FROM (SELECT doc_id, page, [first.line, first.span] AS first FROM (SELECT doc_id, page, {{'line': min(line), 'span': arg_min(span, line * 100 + span)}} AS first FROM (SELECT s.doc_id, s.page, line, span FROM spans s JOIN top USING (doc_id, page) WHERE size >= most - 0.5) GROUP BY doc_id, page))""")
def slide_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a page's largest spans is its title."""
    spans = _spans(spark, sf_dir)
    most = F.max("size").over(Window.partitionBy("doc_id", "page"))
    rows = spans.withColumn("most", most).where(F.col("size") >= F.col("most") - 0.5)
    rows = rows.groupBy("doc_id", "page").agg(F.min(F.struct("line", "span")).alias("x"))
    return rows.select("doc_id", "page", "x.line", F.col("x.span").cast("long").alias("span"))


@query("""WITH f AS (SELECT page_id, ['notes.PDF', 'deck.pptx', 'a.b.md', 'talk.mp3', 'clip.webm', 'data.xyz', 'none'][page_id % 7 + 1] AS path, CASE WHEN page_id % 11 = 0 THEN 'pdf_slides' END AS forced FROM pages
), e AS (SELECT *, coalesce(forced, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'pptx' THEN 'pptx' WHEN 'md' THEN 'md' WHEN 'mp3' THEN 'audio' WHEN 'webm' THEN 'video' END) AS source_type FROM f)
SELECT page_id, path, source_type, CASE WHEN source_type IS NULL THEN 'halt' ELSE 'parse_' || source_type END AS parser FROM e""")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source types by extension, forced ones first, and their parsers."""
    names = F.array(*map(F.lit, ["notes.PDF", "deck.pptx", "a.b.md", "talk.mp3", "clip.webm", "data.xyz", "none"]))
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(names, (F.col("page_id") % 7 + 1).cast("int")).alias("path"), F.when(F.col("page_id") % 11 == 0, "pdf_slides").alias("forced"))
    rows = rows.withColumn("source_type", B.detect_format(F.col("path"), F.col("forced")))
    return rows.select("page_id", "path", "source_type", B.route_parser(F.col("source_type"), F.lit(False)).alias("parser"))


@query(f"""WITH {TEXT_BLOCKS}, r AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks)
SELECT doc_id, ord, (rn // 12)::BIGINT AS batch, (CASE WHEN n <= 12 THEN 0 ELSE rn // greatest(1, n // 12) END)::BIGINT AS chunk FROM r""")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in batches of twelve, and in fallback chunks."""
    rows = B.text_blocks(table(spark, sf_dir, "documents")).select("doc_id", "ord")
    return B.fallback_chunks(B.batches(rows, "doc_id", "ord", 12), "doc_id", "ord", 12).select("doc_id", "ord", F.col("batch").cast("long").alias("batch"), F.col("chunk").cast("long").alias("chunk"))


@query("""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), w AS (SELECT *, unnest(range(0, 1000)) AS batch FROM r)
SELECT doc_id, ord, batch FROM w WHERE batch * 5 <= rn AND rn < batch * 5 + 8 AND (batch = 0 OR (batch - 1) * 5 + 8 < n)""")
def overlapping_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 with an overlap of 3."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"))
    return B.overlapping_batches(rows, "doc_id", "ord", 8, 3)


@query(f"WITH {PAGE_BLOCKS} SELECT p.page_id, CASE WHEN count(b.doc_id) = 0 THEN 'no blocks' END AS error, count(b.doc_id) AS n_blocks FROM pages p LEFT JOIN blocks b ON b.doc_id = p.page_id GROUP BY p.page_id")
def block_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document must have blocks."""
    pages = table(spark, sf_dir, "pages")
    n = B.html_blocks(pages).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n_blocks"))
    rows = pages.select("page_id").join(n, "page_id", "left").fillna(0, ["n_blocks"])
    return rows.select("page_id", F.when(F.col("n_blocks") == 0, "no blocks").alias("error"), "n_blocks")
