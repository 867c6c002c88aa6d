"""Word documents as paragraph rows.

Inserted text stays, deleted and moved-away text goes; paragraphs in tables and in
content controls count in body order; superscript and italic stretches are kept as
half-open offsets; the text of a field shows and its instruction doesn't.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from veldspar.functions.text import with_sections

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_GONE = {f"{_W}del", f"{_W}moveFrom", f"{_W}instrText", f"{_W}delText"}
SHAPE = "doc_id string, idx int, text string, style string, in_table boolean, is_list_item boolean, footnote_ids array<int>, superscript_spans array<struct<start: int, end: int>>, italic_spans array<struct<start: int, end: int>>, error string"


def _on(props, name: str) -> bool:
    x = props.find(f"{_W}{name}") if props is not None else None
    return x is not None and x.get(f"{_W}val", "true") not in ("false", "0", "none")


class _Paragraph:
    """Text gathered with white space collapsed, and the places of marked stretches."""

    def __init__(self):
        self.text, self.notes, self.depth = "", [], 0
        self.spans = {"superscript": [], "italic": []}

    def add(self, piece: str, marks: set[str]) -> None:
        for ch in piece:
            if ch.isspace():
                if not self.text or self.text[-1] == " ":
                    continue
                ch = " "
            at = len(self.text)
            self.text += ch
            for m in marks:
                s = self.spans[m]
                if s and s[-1][1] == at:
                    s[-1][1] = at + 1
                else:
                    s.append([at, at + 1])

    def walk(self, node, marks: set[str]) -> None:
        for x in node:
            if x.tag in _GONE:
                continue
            if x.tag == f"{_W}r":
                props = x.find(f"{_W}rPr")
                own = set()
                if props is not None:
                    v = props.find(f"{_W}vertAlign")
                    own = ({"superscript"} if v is not None and v.get(f"{_W}val") == "superscript" else set()) | ({"italic"} if _on(props, "i") else set())
                self.walk(x, own)
            elif x.tag == f"{_W}t":
                if not self.hidden:
                    self.add(x.text or "", marks)
            elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                self.add(" ", marks)
            elif x.tag == f"{_W}fldChar":
                kind = x.get(f"{_W}fldCharType")
                self.fields += {"begin": [True], "separate": [], "end": []}[kind]
                if kind == "separate" and self.fields:
                    self.fields[-1] = False
                elif kind == "end" and self.fields:
                    self.fields.pop()
            elif x.tag in (f"{_W}footnoteReference", f"{_W}endnoteReference"):
                self.notes.append(int(x.get(f"{_W}id", "0")))
            elif x.tag != f"{_W}pPr":
                self.walk(x, marks)

    fields: list[bool] = []

    @property
    def hidden(self) -> bool:
        return any(self.fields)

    def row(self) -> tuple:
        text = self.text.rstrip()
        cut = {m: [{"start": a, "end": min(b, len(text))} for a, b in s if a < len(text) and text[a:b].strip()] for m, s in self.spans.items()}
        return text, self.notes, cut["superscript"], cut["italic"]


def _blocks(node, in_table: bool):
    for x in node:
        if x.tag == f"{_W}p":
            yield x, in_table
        elif x.tag == f"{_W}tbl":
            yield from ((p, True) for p, _ in _blocks(x, True))
        elif x.tag not in _GONE:
            yield from _blocks(x, in_table)


def parse(data: bytes) -> list[tuple]:
    """Rows after doc_id: idx, text, style, in_table, is_list_item, footnote_ids and both kinds of spans."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out, fields = [], []
    for i, (p, in_table) in enumerate(_blocks(root.find(f"{_W}body"), False)):
        props = p.find(f"{_W}pPr")
        style = props.find(f"{_W}pStyle") if props is not None else None
        one = _Paragraph()
        one.fields = fields  # a field may go on over paragraphs
        one.walk(p, set())
        text, notes, sup, ital = one.row()
        out.append((i, text, style.get(f"{_W}val", "") if style is not None else "Normal", in_table, props is not None and props.find(f"{_W}numPr") is not None, notes, sup, ital))
    return out


def _parsed(batches):
    names = [x.split()[0] for x in SHAPE.replace("struct<start: int, end: int>", "s").split(", ")]
    for pdf in batches:
        rows = []
        for path, data in zip(pdf.path, pdf.content):
            doc = path.rsplit("/", 1)[-1]
            try:
                rows += [(doc, *r, None) for r in parse(data)]
            except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError) as e:
                rows.append((doc, -1, None, None, None, None, None, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of every .docx file below a path with their sections; an unreadable file is one row with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return with_sections(files.mapInPandas(_parsed, SHAPE))
