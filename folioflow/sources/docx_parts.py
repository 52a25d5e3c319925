"""DOCX files as rows: paragraphs with their places, picture references, relationships and names of members.

One pass over the events of a part's XML gives its paragraphs; which of them form a cell, a table, a note or a document is
DataFrame work (``operators.docx``). ``DocxSource`` reads folders (format ``docx``, a partition per file, and only the parts
that a filter asks for); ``paragraphs`` and ``pictures`` read bytes that are in rows already.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

MAIN = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BODY = "word/document.xml"
#: Parts that hold text, in the order of a document: body, footnotes, endnotes.
PARTS = (BODY, "word/footnotes.xml", "word/endnotes.xml")
#: About how many rows of small files leave a worker at once.
ROWS_AT_ONCE = 2000
#: Elements that stand for a character.
MARKS = {"tab": "\t", "br": "\n", "cr": "\n"}
PLACED = "part int, note_no int, note string, block int, kind string, row int, cell int, n int, text string, error string"
REFERENCES = "part string, part_no int, position int, link string, target string, error string"


class Walk:
    """Paragraphs of a container of the body or of a note, from the start and end events of its XML.

    Direct children of the container are blocks. All rows below a table belong to it, those of tables inside its cells too; a cell
    holds every paragraph below it, so what stands in a table inside a cell is told twice, in the outer cell and in a row of its own.
    """

    def __init__(self, note_no: int = 0, note: str = ""):
        self.note_no, self.note = note_no, note
        self.block = self.rows = self.made = 0
        self.path: list[str] = []
        self.cells: list[tuple[int, int]] = []
        self.numbers: list[int] = []  # cells begun in each open row
        self.row_of: list[int] = []
        self.texts: list[list[str]] = []  # of open paragraphs, the outermost first
        self.order: list[int] = []
        self.found: list[tuple] = []

    def _emit(self, kind: str, row: int, cell: int, n: int, text: str) -> None:
        self.found.append((self.note_no, self.note, self.block, kind, row, cell, n, text, ""))

    def start(self, name: str, node: ElementTree.Element) -> None:
        parent = self.path[-1] if self.path else None
        self.path.append(name)
        inside = self.path[0] == "tbl"
        if len(self.path) == 1:
            self.block, self.rows = self.block + 1, 0
        if inside and name == "tr":
            self.row_of.append(self.rows)
            self.rows += 1
            self.numbers.append(0)
        elif inside and name == "tc" and parent == "tr":
            self.cells.append((self.row_of[-1], self.numbers[-1]))
            self.numbers[-1] += 1
            self._emit("table", *self.cells[-1], -1, "")  # a cell is there even without a paragraph
        elif name == "p":
            self.texts.append([])
            self.made += 1
            self.order.append(self.made)
        elif name in MARKS:
            self._say(MARKS[name])
        elif name in ("footnoteReference", "endnoteReference"):
            number = node.get(f"{MAIN}id", "")
            self._say(f"[{number}]" if number and number[0] != "-" else "")

    def _say(self, text: str) -> None:
        for held in self.texts:
            held.append(text)

    def end(self, name: str, node: ElementTree.Element) -> None:
        self.path.pop()
        parent = self.path[-1] if self.path else None
        if name == "t":
            self._say(node.text or "")
        elif name == "p":
            text, n = "".join(self.texts.pop()), self.order.pop()
            for row, cell in self.cells:
                self._emit("table", row, cell, n, text)
            if not self.path:
                self._emit("paragraph", 0, 0, n, text)
        elif self.row_of and name == "tc" and parent == "tr":
            self.cells.pop()
        elif self.row_of and name == "tr":
            self.row_of.pop()
            self.numbers.pop()


def _events(data: bytes) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """Start and end events with names of the main namespace (others as they are). What has ended is let go."""
    for event, node in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        yield event, node.tag.removeprefix(MAIN), node
        if event == "end":
            node.clear()


def part_rows(part: int, data: bytes) -> list[tuple]:
    """Rows (PLACED) of a part. The body's container is its first ``body`` element; a note's is the note, a child of the root."""
    walk, found, depth, at, notes = None, [], 0, None, 0
    for event, name, node in _events(data):
        if event == "start":
            depth += 1
            if walk is not None:
                walk.start(name, node)
            elif at is None and (name == "body" if part == 0 else depth == 2):
                at, notes = depth, notes + 1
                walk = Walk(notes if part else 0, node.get(f"{MAIN}id", "") if part else "")
        else:
            if walk is not None and depth == at:
                if part == 0 or (walk.note and walk.note[0] != "-"):
                    found += [(part, *row) for row in walk.found]
                walk, at = None, None if part else -1  # of the body there is one
            elif walk is not None:
                walk.end(name, node)
            depth -= 1
    if part == 0 and at is None:
        raise ValueError("В DOCX не найден основной текст.")
    return found


def file_rows(data: bytes, parts: set[int] | None = None) -> list[tuple]:
    """Rows (PLACED) of a file, of all its parts or some. ValueError if it has no body."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        if BODY not in names:
            raise ValueError("DOCX не содержит основного текста word/document.xml.")
        return [row for k, name in enumerate(PARTS) if name in names and (parts is None or k in parts) for row in part_rows(k, archive.read(name))]


def told(data: bytes, rows: Callable[[bytes], list[tuple]], width: int) -> list[tuple]:
    """The rows of a file, after one that stands for the file and says why it cannot be read, if so."""
    try:
        found, error = rows(data), ""
    except Exception as problem:  # a broken file must not stop the others
        found, error = [], str(problem) or type(problem).__name__
    return [(None,) * (width - 1) + (error,), *found]


def paragraphs(files: DataFrame) -> DataFrame:
    """doc_id and PLACED of ``files`` (doc_id, content)."""
    return _by_file(files, file_rows, PLACED)


def references(files: DataFrame) -> DataFrame:
    """doc_id and REFERENCES of ``files``: references to pictures (link), relationships (link and target), names (target alone)."""
    return _by_file(files, reference_rows, REFERENCES)


def _by_file(files: DataFrame, rows: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda held: pd.DataFrame(held, columns=names, dtype=object)
        for batch in batches:
            held: list[tuple] = []
            for doc_id, data in zip(batch["doc_id"], batch["content"], strict=True):
                held += [(doc_id, *row) for row in told(data, rows, len(names) - 1)]
                if len(held) >= ROWS_AT_ONCE:
                    yield frame(held)
                    held = []
            if held:
                yield frame(held)

    return files.select("doc_id", "content").mapInPandas(read, f"doc_id long, {schema}")


def _links_of(data: bytes) -> list[str | None]:
    """What each element of a part's XML refers to, in the order of their starts."""
    asked: list[str | None] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = lambda name, given: asked.append(given.get(f"{LINKS[1:]}embed") or given.get(f"{LINKS[1:]}id"))
    parser.Parse(data, True)
    return asked


def reference_rows(data: bytes) -> list[tuple]:
    """Rows (REFERENCES) of a file. Parts are numbered: the body, headers and footers by name, footnotes and endnotes.

    A part whose XML, or whose relationships' XML, cannot be read gives none.
    """
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        out += [(None, None, None, None, name, "") for name in sorted(names)]
        margins = sorted(n for n in names if re.fullmatch(r"word/(header|footer)\d+\.xml", n))
        for number, part in enumerate([BODY, *margins, *PARTS[1:]]):
            folder, name = posixpath.split(part)
            links = f"{folder}/_rels/{name}.rels"
            if part not in names or links not in names:
                continue
            try:
                asked = _links_of(archive.read(part))
                given = [dict(node.attrib) for node in ElementTree.fromstring(archive.read(links))]
            except (ElementTree.ParseError, expat.ExpatError):
                continue
            out += [(part, number, place, link, None, "") for place, link in enumerate(asked) if link]
            out += [
                (part, None, place, g["Id"], posixpath.normpath(posixpath.join(folder, g["Target"])), "")
                for place, g in enumerate(given)
                if g.get("Id") and g.get("Target") and g.get("TargetMode") != "External" and g.get("Type", "").endswith("/image")
            ]
    return out


def members(wanted: DataFrame) -> DataFrame:
    """doc_id, number, target and content of ``wanted`` (doc_id, content, targets: array of (number, target)); a member that cannot be read gives no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, data, targets in zip(batch["doc_id"], batch["content"], batch["targets"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for t in targets:
                        try:
                            rows.append((doc_id, t["number"], t["target"], archive.read(t["target"])))
                        except Exception:  # a broken picture must not stop the others
                            continue
                yield pd.DataFrame(rows, columns=["doc_id", "number", "target", "content"])

    return wanted.select("doc_id", "content", "targets").mapInPandas(read, "doc_id long, number int, target string, content binary")


class DocxSource(DataSource):
    """``spark.read.format("docx").load(folder)``: path and PLACED of every DOCX file below a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return f"path string, {PLACED}"

    def reader(self, schema) -> DocxFiles:  # the name is given by Spark's interface
        return DocxFiles(self.options["path"])


class DocxFiles(DataSourceReader):
    """Files are partitions. Filters on ``path`` leave files out, filters on ``part`` leave parts of files unread."""

    def __init__(self, folder: str):
        self.folder, self.paths, self.parts = folder, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("path",), ("part",)):
                yield f
            elif f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                self.parts = values if self.parts is None else self.parts & values
                yield f  # the row that stands for a file has no part

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(top, name) for top, _, names in os.walk(self.folder) for name in names if name.lower().endswith(".docx"))
        return [InputPartition(path) for path in found if self.paths is None or path in self.paths] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            with open(partition.value, "rb") as file:
                data = file.read()
            parts = self.parts
            yield from ((partition.value, *row) for row in told(data, lambda x: file_rows(x, parts), len(PLACED.split(", "))))


def register(spark: SparkSession) -> None:
    """Make the format ``docx`` known, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocxSource)


def _paragraph(text: str, mark: str = "") -> str:
    return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t>{mark}</w:r></w:p>'


def document(blocks: list[str | list[list[str]]], notes: dict[str, str] | None = None, pictures: list[str] | None = None, links: list[tuple[str, str, bool]] | None = None) -> bytes:
    """A DOCX file: blocks are paragraphs or tables (lists of rows of cells); notes by id, each referred to at the end of the first paragraph.

    ``pictures`` are the links that the body refers to, in order; ``links`` (id, target, external) its relationships. Targets inside are there, with their names as content.
    """
    marks = "".join(f'<w:footnoteReference w:id="{n}"/>' for n in notes or {})
    parts, fresh = [], True
    for block in blocks:
        if isinstance(block, str):
            parts.append(_paragraph(block, marks if fresh else ""))
            fresh = False
        else:
            parts.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in block) + "</w:tbl>")
    parts += [f'<w:p><w:blip r:embed="{link}"/></w:p>' for link in pictures or []]
    spaces = f'xmlns:w="{MAIN[1:-1]}" xmlns:r="{LINKS[1:-1]}"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(BODY, f"<w:document {spaces}><w:body>{''.join(parts)}</w:body></w:document>")
        if notes:
            archive.writestr(PARTS[1], f"<w:footnotes {spaces}>" + "".join(f'<w:footnote w:id="{n}">{_paragraph(t)}</w:footnote>' for n, t in notes.items()) + "</w:footnotes>")
        if links:
            shown = (f'<Relationship Id="{n}" Type="{LINKS[1:-1]}/image" Target="{escape(t)}"{" TargetMode=" + chr(34) + "External" + chr(34) if x else ""}/>' for n, t, x in links)
            archive.writestr("word/_rels/document.xml.rels", f"<Relationships>{''.join(shown)}</Relationships>")
            for target in sorted({t for _, t, x in links if not x and not t.startswith("gone")}):
                archive.writestr(posixpath.normpath(f"word/{target}"), target)
    return out.getvalue()
