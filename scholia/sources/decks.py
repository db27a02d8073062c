"""Slide decks as a data source: `decks` writes a file for each row and reads files back as blocks.

Paths are opened through `pyarrow.fs`, so the folder may be local, shared or remote. Reading deals files to partitions by their sizes
(whole files, about `bytes` a partition, 32 MB unless set); a schema given to the reader names the columns that are made. A deck is written under a name
of its own and then moved into place, so that a task that runs twice leaves one.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .slides import BLOCKS, A, P, R, deck_blocks

_LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
_SPACES = f'xmlns:a="{A[1:-1]}" xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}"'
#: Characters that the format can't hold.
_BARRED = {c: " " for c in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF]}


def deck(slides: list) -> bytes:
    """A deck of `slides(title, body(text, indent, bullet))`."""

    def paragraph(text: str | None, indent: int | None, bullet: bool | None) -> str:
        form = f'<a:pPr lvl="{indent or 0}">{"<a:buChar char=\"•\"/>" if bullet else ""}</a:pPr>'
        return f"<a:p>{form}<a:r><a:t>{escape((text or '').translate(_BARRED))}</a:t></a:r></a:p>"

    def shape(mark: str, body: str) -> str:
        return f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"

    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="s{i}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f"<p:presentation {_SPACES}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        links = "".join(f'<Relationship Id="s{i}" Target="slides/slide{i}.xml"/>' for i in range(len(slides)))
        z.writestr("ppt/_rels/presentation.xml.rels", f'<Relationships xmlns="{_LINKS}">{links}</Relationships>')
        for i, slide in enumerate(slides):
            title = shape('<p:ph type="title"/>', paragraph(slide["title"], 0, False))
            body = shape('<p:ph idx="1"/>', "".join(paragraph(*p) for p in slide["body"] or []))
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {_SPACES}><p:cSld><p:spTree>{title}{body}</p:spTree></p:cSld></p:sld>")
    return out.getvalue()


class Files(InputPartition):
    """Whole files that are read together."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class DeckReader(DataSourceReader):
    def __init__(self, path: str, most: int, columns: list[str]):
        self.path, self.most, self.columns = path, most, columns

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out: list[Files] = []
        size = self.most
        for info in sorted(found, key=lambda x: x.path):
            if info.type == fs.FileType.File and info.base_name.lower().endswith(".pptx") and not info.base_name.startswith((".", "_")):
                if size + info.size > self.most:
                    out.append(Files([]))
                    size = 0
                out[-1].paths.append(info.path)
                size += info.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            try:
                rows = [{"path": path, "ord": i, "slide": s, "kind": k, "indent": n, "text": t} for i, (s, k, n, t) in enumerate(deck_blocks(system.open_input_file(path).read()))]
                rows = rows or [{"path": path, "error": "no text"}]
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                rows = [{"path": path, "error": f"broken deck: {type(e).__name__}"}]
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)


class DeckWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for row in iterator:
            own = f"{root}/.{row['name']}-{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(deck(row["slides"] or []))
            system.move(own, f"{root}/{row['name']}.pptx")
        return WriterCommitMessage()


class Decks(DataSource):
    """Reads BLOCKS of all decks below the path; writes `name` and `slides(title, body(text, indent, bullet))`."""

    @classmethod
    def name(cls) -> str:
        return "decks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> DeckReader:
        return DeckReader(self.options["path"], int(self.options.get("bytes", 32 << 20)), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DeckWriter:
        return DeckWriter(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source registered."""
    spark.dataSource.register(Decks)
    return spark
