"""Accepting tracked changes in packaged documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.sources.packages import attr, local, parse_xml

# Element names that go with what they hold, and those whose contents stay.
DROPPED = frozenset("del delText delInstrText cellDel moveFrom moveFromRangeStart moveFromRangeEnd moveToRangeStart moveToRangeEnd customXmlDelRangeStart customXmlDelRangeEnd customXmlMoveFromRangeStart customXmlMoveFromRangeEnd customXmlMoveToRangeStart customXmlMoveToRangeEnd trackRevisions numberingChange cellMerge".split())
UNWRAPPED = frozenset("ins moveTo customXmlInsRangeStart customXmlInsRangeEnd cellIns".split())


def _gone(node: ET.Element) -> bool:
    name = local(node.tag)
    if name in DROPPED or name.endswith("Change"):
        return True
    marks = {"tr": ("trPr", ("del", "cellDel", "cellMerge")), "tc": ("tcPr", ("del", "cellDel"))}.get(name)
    return bool(marks) and any(local(c.tag) in marks[1] for p in node if local(p.tag) == marks[0] for c in p)


def accept(root: ET.Element) -> ET.Element:
    """The tree without deleted content and revision marks, inserted content in its place."""

    def rebuilt(node: ET.Element) -> list[ET.Element]:
        if _gone(node):
            return []
        kids = [k for child in node for k in rebuilt(child)]
        if local(node.tag) in UNWRAPPED:
            return kids
        out = ET.Element(node.tag, node.attrib)
        out.text = node.text
        out.extend(kids)
        return [out]

    top = ET.Element(root.tag, root.attrib)
    top.text = root.text
    top.extend([k for child in root for k in rebuilt(child)])
    return top


def accept_package(data: bytes) -> bytes:
    """A document with its changes accepted; comments nobody refers to any more go, those without id stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        trees = {n: accept(parse_xml(z.read(n))) for n in z.namelist() if n.startswith("word/") and n.endswith(".xml") and "_rels/" not in n and not n.endswith("fontTable.xml")}
        live = {attr(x, "id") for n, t in trees.items() if not n.endswith("comments.xml") for x in t.iter() if local(x.tag) in ("commentReference", "commentRangeStart")}
        for name, tree in trees.items():
            if name.endswith("comments.xml"):
                for c in [c for c in tree if local(c.tag) == "comment" and attr(c, "id") is not None and attr(c, "id") not in live]:
                    tree.remove(c)
        for item in z.infolist():
            w.writestr(item, ET.tostring(trees[item.filename], encoding="utf-8", xml_declaration=True) if item.filename in trees else z.read(item.filename))
    return out.getvalue()


def accept_all(files: DataFrame) -> DataFrame:
    """path and content of documents with changes accepted; one that cannot be read has null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(accept_package(data) if data is not None else None)
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")
