"""XML documents into node rows, with a finding for each element that the mapping does not know."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.session import ship

NODES = "doc_id long, addr string, parent string, depth int, ord int, kind string, label string, text string, finding string"
#: Elements that make nodes; 'body' is transparent.
KINDS = ("part", "chapter", "section", "subsection", "paragraph", "subparagraph", "point", "heading", "content", "num")


def nodes_of(doc_id: int, xml: str) -> Iterator[tuple]:
    """Rows of a document in preorder. Broken XML gives one row with a finding."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        yield doc_id, None, None, 0, 0, None, None, None, f"xml_error: {e.code}"
        return
    stack: list[tuple[ET.Element, str, int, int]] = [(root, "", 0, 0)]
    while stack:
        element, parent, depth, place = stack.pop()
        kind = element.tag.rpartition("}")[2]
        num = next((c.text for c in element if c.tag.rpartition("}")[2] == "num"), None)
        label = (element.get("num") or num or "").strip() or None
        own = parent
        if kind in KINDS or depth == 0:
            if label or depth == 0:
                own = f"{parent}/{kind}:{label}" if parent and label else f"{kind}:{label}" if label else parent
            text = " ".join((element.text or "").split()) or None
            yield doc_id, own or None, parent or None, depth, place, kind, label, text, None
        elif kind != "body":
            yield doc_id, None, parent or None, depth, place, kind, label, None, "unmapped_element"
        stack += [(c, own, depth + 1, i) for i, c in reversed(list(enumerate(element)))]


def xml_nodes(docs: DataFrame, key: str = "doc_id", xml: str = "xml") -> DataFrame:
    """Node rows of a table of XML strings."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for k, x in zip(part[key], part[xml], strict=True) for r in nodes_of(int(k), x or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "addr", "parent", "depth", "ord", "kind", "label", "text", "finding"])

    ship(docs.sparkSession)
    return docs.select(key, xml).mapInPandas(run, NODES)
