"""Citable units of documents: sentences and table rows, each with its heading and its place in the text without white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .corpus import SENTENCE

_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_RULE = re.compile(r"\|[\s:|-]+\|?")
_NAMES = ["seq", "kind", "unit", "heading", "header", "line", "start", "end"]
UNIT = "seq int, kind string, unit string, heading string, header array<string>, line int, start long, end long"


def _cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().strip("|").split("|")]


def _units(text: str) -> Iterator[tuple]:
    """kind, unit, heading, header and line of a text's units, in order; rows of a table follow its first row, that is its header."""
    path: list[tuple[int, str]] = []
    header: list[str] | None = None
    for line, raw in enumerate(text.split("\n")):
        row, above = raw.strip(), " / ".join(t for _, t in path)
        if row.startswith("|"):
            if header is None:
                header = _cells(row)
            elif not _RULE.fullmatch(row):
                yield "table", row, above, header, line
            continue
        header = None
        head = _HEADING.match(raw)
        if head:
            level, title = len(head[1]), head[2].strip()
            path = [p for p in path if p[0] < level]
            if title:
                yield "heading", title, " / ".join(t for _, t in path), [], line
                path.append((level, title))
            continue
        for sentence in re.findall(SENTENCE, raw):
            if sentence.strip():
                yield "text", sentence.strip(), above, [], line


def located(text: str | None) -> list[tuple]:
    """The units of a text: each distinct one at its first place, found from behind the unit before it on, in one pass."""
    text = text or ""
    bare = re.sub(r"\s+", "", text)
    out, seen, cursor = [], set(), 0
    for kind, unit, heading, header, line in _units(text):
        if unit in seen:
            continue
        seen.add(unit)
        needle = re.sub(r"\s+", "", unit)
        start = bare.find(needle, cursor)
        cursor = max(cursor, start + len(needle))
        out.append((len(out), kind, unit, heading, header, line, start, start + len(needle)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))
        for i, text in enumerate(texts.to_pylist()):
            rows = located(text)
            if rows:
                kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([ids.take(pa.array([i] * len(rows))), *columns], names=["doc_id", *_NAMES])


def citable_units(docs: DataFrame) -> DataFrame:
    """doc_id, seq, kind (text, heading or table), unit, heading, header, line, start, end for docs (doc_id, text).

    A unit is a sentence, the title of a heading or a row of a Markdown table below its header; one that repeats is one unit, at its first place.
    ``heading`` names the headings above it, ``header`` the cells of its table's header. start and end count characters of the text without
    white space; each is looked for behind the unit before it, so places never go back. Rows that repeat a doc_id are each read; a null or
    empty text has no units. Only this reading is Python: one pass over each text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {kind}, {UNIT}")
