"""A folder of XML documents as a Spark data source: ``spark.read.format("xml_records")``.

Files are listed once and dealt to tasks by size. With the option ``record`` (an element's name) a file holds many documents and is split by bytes: a
task reads the records that begin in its part, to their end, wherever that is, so that each is read once and by one task. Without it a file is one
record. A record that is no XML, is cut off, or is in an unknown encoding becomes a row with an error and not a failure; so does a file
that cannot be read.

    register(spark)
    spark.read.format("xml_records").option("path", folder).option("record", "act").load()      # path, start, xml, error
    xml_nodes(records…) or repaired_nodes(records…)                                               # node rows with findings

Paths are local or any that pyarrow's file systems know; :func:`whole_files` reads through Spark's own file systems instead.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.session import ship

RECORDS = "path string, start long, xml string, error string"
#: Bytes to a partition, about, and to a read.
PART, READ = 32 << 20, 1 << 20


class FilePart(InputPartition):
    """Bytes ``start`` to ``end`` of a file, or of several small files all of theirs."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files


def decoded(data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a record's bytes, by its own declaration, else UTF-8."""
    declared = re.match(rb"^\xef?\xbb?\xbf?\s*<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", data[:200])
    try:
        return data.decode(declared[1].decode() if declared else "utf-8-sig"), None
    except (UnicodeDecodeError, LookupError) as e:
        return None, f"encoding: {e}"[:200]


def checked(data: bytes) -> tuple[str | None, str | None]:
    """(text, error): the text stays where it can be read, so that whoever handles errors sees what was there."""
    text, error = decoded(data)
    if text is not None:
        try:
            ET.fromstring(data)
        except ET.ParseError as e:
            error = f"xml: {e}"
        except (ValueError, LookupError) as e:
            error = f"encoding: {e}"[:200]
    return text, error


def records_in(read, size: int, start: int, end: int, name: str) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin from ``start`` on and before ``end``; ``read(at, n)`` gives bytes of the file. A record goes to its end tag,
    or to the next record's start or the file's end if it has none. Records do not nest in each other."""
    tag = name.encode()
    opening, closing = re.compile(rb"<" + re.escape(tag) + rb"(?=[\s/>])"), re.compile(rb"</" + re.escape(tag) + rb"\s*>")
    longest = len(tag) + 3
    at, data = start, b""  # data begins at place ``at`` of the file

    def more() -> bool:
        nonlocal data
        got = read(at + len(data), READ) if at + len(data) < size else b""
        data += got
        return bool(got)

    while True:
        m = opening.search(data)
        while not m and at + len(data) < min(size, end + longest):
            cut = max(0, len(data) - longest)
            at, data = at + cut, data[cut:]
            if not more():
                break
            m = opening.search(data)
        if not m or at + m.start() >= end:
            return
        at, data = at + m.start(), data[m.start() :]
        looked = 1
        while True:
            stop, following = closing.search(data, looked), opening.search(data, max(1, looked))
            empty = re.match(rb"<" + re.escape(tag) + rb"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>", data)
            if empty:
                n = empty.end()
                break
            if stop and (not following or stop.start() < following.start()):
                n = stop.end()
                break
            if following:
                n = following.start()
                break
            looked = max(1, len(data) - longest)
            if not more():
                n = len(data)
                break
        yield at, data[:n]
        at, data = at + n, data[n:]


class XmlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.record = options["path"], options.get("record")
        self.part, self.suffix = int(options.get("part", PART)), options.get("suffix", ".xml")

    def _fs(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, folder = self._fs()
        found = system.get_file_info(folder)
        listed = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size or 0) for f in listed if f.type == fs.FileType.File and (f.path.endswith(self.suffix) or f.path == folder))
        out: list[InputPartition] = []
        small: list[tuple[str, int, int]] = []
        held = 0
        for path, size in files:
            if self.record and size > self.part:
                out += [FilePart([(path, s, min(size, s + self.part))]) for s in range(0, size, self.part)]
                continue
            if small and held + size > self.part:
                out.append(FilePart(small))
                small, held = [], 0
            small, held = [*small, (path, 0, size)], held + size
        return out + ([FilePart(small)] if small else [])

    def read(self, partition: FilePart) -> Iterator[tuple]:  # type: ignore[override]
        system, _ = self._fs()
        for path, start, end in partition.files:
            try:
                with system.open_input_file(path) as f:
                    size = f.size()
                    found = records_in(lambda at, n: f.read_at(n, at), size, start, end, self.record) if self.record else [(0, f.read_at(size, 0))]  # noqa: B023
                    for place, data in found:
                        yield (path, place, *checked(data))
            except OSError as e:
                yield path, start, None, f"unreadable: {e}"[:200]


class XmlRecords(DataSource):
    """The data source ``xml_records``."""

    @classmethod
    def name(cls) -> str:
        return "xml_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: object) -> XmlReader:
        return XmlReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session."""
    ship(spark)
    spark.dataSource.register(XmlRecords)


def whole_files(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """The same rows for files of one document each, read through Spark's file systems, which leave out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, 0, *checked(c or b"")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["path", "start", "xml", "error"])

    ship(spark)
    return files.select("path", "content").mapInArrow(run, RECORDS)


# ---------------------------------------------------------------- repairs


def _kind(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _num(e: ET.Element) -> str:
    """The label of an element: its attribute or its number, without marks around it."""
    found = e.get("num") or next((c.text for c in e if _kind(c) == "num"), None) or ""
    return re.sub(r"[\s§().:]+", "", found).lower()


def repair(root: ET.Element) -> list[tuple[str, str]]:
    """Mends what sources commonly get wrong, in place; (repair, detail) of each mend.

    absorb_orphaned_subsection: subsections that follow a section that was closed too early go into it, and get the next number if they have none.
    rehome_orphaned_letter: an item with the letter after the last sub-item of the item before it goes under that. positional_label: subsections of a
    section without number get their place."""
    done = []
    for parent in root.iter():
        kept: list[ET.Element] = []
        for child in list(parent):
            kind, before = _kind(child), kept[-1] if kept else None
            if kind == "subsection" and before is not None and _kind(before) == "section" and _kind(parent) != "section":
                if not _num(child):
                    child.set("num", str(1 + sum(_kind(c) == "subsection" for c in before)))
                before.append(child)
                done.append(("absorb_orphaned_subsection", f"{_num(before)}/{_num(child)}"))
                continue
            letter = _num(child)
            if kind == "paragraph" and len(letter) == 1 and letter.isalpha() and before is not None and _kind(before) == "paragraph":
                below = [_num(c) for c in before if _kind(c) == "subparagraph"]
                if below and len(below[-1]) == 1 and ord(letter) == ord(below[-1]) + 1:
                    child.tag = child.tag.replace("paragraph", "subparagraph")
                    before.append(child)
                    done.append(("rehome_orphaned_letter", f"{_num(before)}/{letter}"))
                    continue
            kept.append(child)
        if len(kept) != len(parent):
            for child in list(parent):
                if all(child is not k for k in kept):
                    parent.remove(child)
    for section in root.iter():
        if _kind(section) == "section":
            for place, child in enumerate((c for c in section if _kind(c) == "subsection"), 1):
                if not _num(child):
                    child.set("num", str(place))
                    done.append(("positional_label", f"{_num(section)}/{place}"))
    return done


REPAIRED = "path string, start long, xml string, error string, repairs array<struct<repair:string,detail:string>>"


def repaired(records: DataFrame) -> DataFrame:
    """Records with ``repairs``, and ``xml`` as mended; those with an error stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xmls, repairs = [], []
            for xml, error in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                made: list[tuple[str, str]] = []
                if xml is not None and error is None:
                    root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml))
                    made = repair(root)
                    xml = ET.tostring(root, encoding="unicode") if made else xml
                xmls.append(xml)
                repairs.append([{"repair": r, "detail": d} for r, d in made])
            kind = pa.list_(pa.struct([("repair", pa.string()), ("detail", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xmls, pa.string()), batch.column(3), pa.array(repairs, kind)], names=["path", "start", "xml", "error", "repairs"])

    ship(records.sparkSession)
    return records.select("path", "start", "xml", "error").mapInArrow(run, REPAIRED)


def findings(repaired_records: DataFrame) -> DataFrame:
    """(path, start, finding, detail): errors and repairs as rows."""
    errors = repaired_records.filter("error is not null").select("path", "start", F.lit("unreadable").alias("finding"), F.col("error").alias("detail"))
    mended = repaired_records.select("path", "start", F.explode("repairs").alias("r")).select("path", "start", F.col("r.repair").alias("finding"), F.col("r.detail").alias("detail"))
    return errors.unionByName(mended)
