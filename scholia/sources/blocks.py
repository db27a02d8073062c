"""Sources: files and texts as ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

# Source types by file extension.
TYPES = {"pdf": "pdf", "pptx": "pptx", "ppt": "pptx", "md": "md", "markdown": "md", "mp3": "audio", "wav": "audio", "m4a": "audio", "flac": "audio", "ogg": "audio", "mp4": "video", "mkv": "video", "mov": "video", "webm": "video", "avi": "video"}
BULLETS = "[•\\-*–▪◦·]"


def detect_format(path: Column, forced: Column | None = None) -> Column:
    """The source type of a path, null if unknown; a forced type wins."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = F.lit(None).cast("string")
    for kind in sorted(set(TYPES.values())):
        found = F.when(extension.isin([e for e, t in TYPES.items() if t == kind]), kind).otherwise(found)
    return found if forced is None else F.coalesce(forced, found)


def route_parser(kind: Column, failed: Column) -> Column:
    """The parser of a source type; `halt` for errors and unknown types."""
    parser = F.when(kind.isin("pdf", "pdf_notes"), "parse_pdf").when(kind == "pdf_slides", "parse_pdf_slides").when(kind.isin("pptx", "md", "audio", "video"), F.concat(F.lit("parse_"), kind))
    return F.when(failed, "halt").otherwise(F.coalesce(parser, F.lit("halt")))


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, ord, kind, level, text of headings, paragraphs and list items, in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h1[^>]*>.*?</h1>|<p>.*?</p>|<li>.*?</li>"), F.lit(0))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("ord", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
    kind = F.when(F.col("raw").startswith("<h1"), "heading").when(F.col("raw").startswith("<li"), "list_item").otherwise("paragraph")
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), F.when(kind == "heading", 1).otherwise(0).alias("level"), text.alias("text")).where("text <> ''")


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, ord, kind, level, text, lo, hi of each line that isn't blank.

    Lines of one to three words are headings of that level; lo and hi are the line's place in the text.
    """
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lo", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))
    text = stripped(F.col("line"))
    words = F.size(F.split(text, r"\s+"))
    level = F.when(words <= 3, words).otherwise(0).cast('long')
    kind = F.when(words <= 3, "heading").when(text.rlike("^" + BULLETS), "list_item").otherwise("paragraph")
    return rows.where(text != "").select("doc_id", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), level.alias("level"), text.alias("text"), "lo", (F.col("lo") + F.length("line")).cast("long").alias("hi"))


def body_size(spans: DataFrame) -> DataFrame:
    """doc_id and the median size of spans that aren't blank on the first 20 pages, 11.0 without any."""
    found = spans.where((F.col("page") < 20) & (stripped(F.col("text")) != "")).groupBy("doc_id").agg(F.median("size").alias("body"))
    return spans.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit(11.0)).alias("body"))


def numbered(text: Column) -> Column:
    """Whether a line begins like an item of a numbered list."""
    return text.rlike(r"^([0-9][.)] |\p{L}\) )") & (F.length(text) >= 3)


def line_kind(text: Column, size: Column, body: Column) -> Column:
    """Heading by size, list item by its beginning, else paragraph."""
    return F.when((size >= 1.18 * body) & (F.length(text) <= 120), "heading").when(text.rlike("^" + BULLETS) | numbered(text), "list_item").otherwise("paragraph")


def pdf_lines(spans: DataFrame) -> DataFrame:
    """Lines of spans(doc_id, page, line, span, text, size): joined text, largest size, kind and place on the page."""
    lines = spans.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"), F.max("size").alias("size")).where(stripped(F.col("text")) != "")
    before = Window.partitionBy("doc_id", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("lo", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))
    return lines.join(body_size(spans), "doc_id").withColumn("kind", line_kind(F.col("text"), F.col("size"), F.col("body")))


def has_structure(kind: Column, headings: Column, titles: Column, blocks: Column) -> Column:
    """Whether a source's layout gives its outline."""
    ratio = headings / F.nullif(blocks, F.lit(0))
    return F.coalesce(F.when(kind.isin("pdf_slides", "pptx"), titles > 0).when(kind == "md", headings > 0).when(kind.isin("pdf", "pdf_notes"), (headings >= 3) & ratio.between(0.005, 0.25)), F.lit(False))


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """`rows` with batch: consecutive groups of `size` within each key."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def overlapping_batches(rows: DataFrame, key: str, order: str, size: int = 80, overlap: int = 5) -> DataFrame:
    """`rows` in each of the windows they belong to; the last window is the first that reaches the end."""
    step = size - overlap
    w = Window.partitionBy(key)
    rows = rows.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step))
    first = F.greatest(F.lit(0), F.floor((F.col("rn") - size) / step) + 1)
    return rows.withColumn("batch", F.explode(F.sequence(first.cast("long"), F.least(F.floor(F.col("rn") / step), last).cast("long")))).drop("rn", "n")


def fallback_chunks(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """`rows` with chunk: one group up to `most` rows, else chunks of n // most rows."""
    w = Window.partitionBy(key)
    n, rn = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return rows.withColumn("chunk", F.when(n <= most, F.lit(0)).otherwise(F.floor((rn - 1) / F.greatest(F.lit(1), F.floor(n / most)))))


def utterances(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of transcripts' segments(doc_id, seg, start, end, text) with their times, and documents without speech."""
    rows = segments.withColumn("text", F.coalesce(stripped(F.col("text")), F.lit("")))
    blocks = rows.where("text <> ''").select("doc_id", F.col("seg").alias("ord"), F.lit("utterance").alias("kind"), "text", F.col("start").alias("lo"), F.col("end").alias("hi"))
    silent = rows.groupBy("doc_id").agg(F.max("text").alias("most")).where("most = ''").select("doc_id", F.lit("no speech").alias("error"))
    return blocks, silent
