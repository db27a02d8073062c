"""Slide decks (Office Open XML) as blocks, with the standard library."""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces of the format.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

BLOCKS = "path string, ord long, slide int, kind string, indent int, text string, error string"


def _said(paragraph: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in paragraph.findall(f"{A}r/{A}t")).strip()


def _slides(deck: zipfile.ZipFile) -> Iterator[ElementTree.Element]:
    """The slides in the order of the presentation."""
    links = ElementTree.fromstring(deck.read("ppt/_rels/presentation.xml.rels"))
    target = {link.get("Id"): link.get("Target") for link in links}
    for s in ElementTree.fromstring(deck.read("ppt/presentation.xml")).iter(f"{P}sldId"):
        yield ElementTree.fromstring(deck.read(posixpath.normpath(posixpath.join("/ppt", target[s.get(f"{R}id")])).lstrip("/")))


def deck_blocks(content: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(slide, kind, indent, text) of each title and each paragraph that isn't blank, slide by slide, titles first."""
    with zipfile.ZipFile(BytesIO(content)) as deck:
        for number, slide in enumerate(_slides(deck), 1):
            titles, body = [], []
            for shape in slide.findall(f"{P}cSld/{P}spTree/{P}sp"):
                mark = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                is_title = mark is not None and mark.get("idx", "0") == "0"
                (titles if is_title else body).extend(shape.findall(f"{P}txBody/{A}p"))
            title = "\n".join(map(_said, titles)).strip()
            if title:
                yield number, "slide_title", 0, title
            for paragraph in body:
                form = paragraph.find(f"{A}pPr")
                bullet = form is not None and any(form.find(A + t) is not None for t in ("buChar", "buAutoNum"))
                if _said(paragraph):
                    yield number, "bullet" if bullet else "body", int(form.get("lvl", 0)) if form is not None else 0, _said(paragraph)


def read_decks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all decks below the path; a deck that is broken or has no text gives one row with its error."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                try:
                    rows = [(name, i, *b, None) for i, b in enumerate(deck_blocks(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows = [(name, None, None, None, None, None, f"broken deck: {type(e).__name__}")]
                rows = rows or [(name, None, None, None, None, None, "no text")]
                yield pd.DataFrame(rows, columns=["path", "ord", "slide", "kind", "indent", "text", "error"]).astype({"ord": "Int64", "slide": "Int32", "indent": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), "content").mapInPandas(parse, BLOCKS)
