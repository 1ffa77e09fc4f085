"""A tokenizer of markup, and elements of pages by tag and class."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Comments, declarations, end tags and start tags; anything else is text.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/=>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that hold no markup, and such as have no end tag.
RAW = ("script", "style")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) of start and end tags and of text between them, in order; character references are
    resolved, comments and declarations left out, and what scripts and styles hold is kind raw."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", html.unescape(text), {}
        if not m:
            return
        at = m.end()
        if m["end"]:
            yield "end", m["end"].lower(), {}
        elif m["start"]:
            name = m["start"].lower()
            found: dict[str, str] = {}
            for a in ATTRIBUTE.finditer(m["rest"]):
                found.setdefault(a[1].lower(), html.unescape(next((v for v in a.groups()[1:] if v is not None), "")))
            yield "start", name, found
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                end = close.start() if close else len(page)
                if end > at:
                    yield "raw", page[at:end], {}
                at = end


def found(page: str, tag: str, cls: str | None, attribute: str) -> list[tuple[str | None, str]]:
    """The attribute and the text of each element of a tag, and of a class if one is given, by the places of their start
    tags. Elements within others count too; one without its end tag ends with the page."""
    out: list[list] = []
    inside: list[tuple[int, int]] = []  # an element's number, and how many of its tag are open within it
    for kind, value, attributes in events(page):
        if kind == "text":
            for number, _ in inside:
                out[number][1].append(value)
        elif kind == "start" and value == tag:
            inside = [(n, depth + 1) for n, depth in inside]
            if cls is None or cls in attributes.get("class", "").split():
                out.append([attributes.get(attribute), []])
                if tag not in VOID:
                    inside.append((len(out) - 1, 1))
        elif kind == "end" and value == tag:
            inside = [(n, depth - 1) for n, depth in inside if depth > 1]
    return [(value, " ".join("".join(parts).split())) for value, parts in out]


def elements(pages: DataFrame, tag: str, cls: str | None = None, attribute: str = "href", id: str = "page_id", text: str = "html") -> DataFrame:
    """id, n (from 0), value and text: elements of pages by tag and class, with one of their attributes. Narrow; a null page has none."""
    kind = dict(pages.dtypes)[id]

    def run(batches):
        for r in batches:
            rows = [(key, n, value, inner) for key, page in zip(r.column("id").to_pylist(), r.column("page").to_pylist(), strict=True) for n, (value, inner) in enumerate(found(page or "", tag, cls, attribute))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], r.schema.field("id").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["id", "n", "value", "text"])

    rows = pages.select(F.col(id).alias("id"), F.col(text).alias("page")).mapInArrow(run, f"id {kind}, n int, value string, text string")
    return rows.withColumnRenamed("id", id)
