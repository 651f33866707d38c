"""A data source of score markup: ``spark.read.format("scores").load(folder)`` gives element rows, parsed as a stream.

A file is read in pieces and a measure is dropped once its rows are out, so no file is ever whole in memory or in a cell. Files are dealt into input
parts by their size. A file is checked before its first row goes out, so one that doesn't parse, or has no part, is one row with an ``error``.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from xml.parsers import expat

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sparkstave.schemas import ELEMENTS

#: Bytes read at once, bytes of the files of one input part, and what a small file counts there: its opening and parsing take their time too.
PIECE, PART, LEAST = 1 << 16, 1 << 26, 1 << 16
#: What is looked for under an element, in the order of the columns.
UNDER = ("step", "alter", "octave", "staff", "voice", "beats", "beat-type", "fifths", "divisions")


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def measure_rows(file: str, part_idx: int, order: int, measure: ET.Element) -> Iterator[tuple]:
    """The measure's own row (tag ``measure``, child_pos -1) and one for each of its children."""
    place = (file, part_idx, order, measure.get("number"))
    yield (*place, -1, "measure", *[None] * (len(ELEMENTS) - 6))
    for pos, child in enumerate(measure):
        under: dict = {}
        for x in child.iter():
            if x is not child:
                under.setdefault(local_name(x.tag), (x.text or "").strip())
        if "time" in under:  # free metre: a time without beats is still a time
            under.setdefault("beats", "")
        clefs = []
        for c in (x for x in child if local_name(x.tag) == "clef"):
            said = {local_name(x.tag): (x.text or "").strip() for x in c}
            clefs.append({"number": c.get("number"), "sign": said.get("sign"), "line": said.get("line")})
        ties = " ".join(x.get("type", "") for x in child if local_name(x.tag) == "tie")
        yield (*place, pos, local_name(child.tag), under.get("duration"), "chord" in under, "rest" in under, *[under.get(k) for k in UNDER], clefs, ties or None, None)


def element_rows(file: str, pieces: Iterable[str | bytes]) -> Iterator[tuple]:
    """Rows of one file from its pieces; parts are numbered as they open, measures count that stand right in a part."""
    parser = ET.XMLPullParser(("start", "end"))
    opened: list[ET.Element] = []
    orders: list[list[int]] = []  # number and last measure of the parts that are open
    n_parts = 0

    def rows() -> Iterator[tuple]:
        nonlocal n_parts
        for event, x in parser.read_events():
            name = local_name(x.tag)
            if event == "start":
                opened.append(x)
                if name == "part":
                    orders.append([n_parts, 0])
                    n_parts += 1
                continue
            opened.pop()
            if name == "part":
                orders.pop()
            if name == "measure" and opened and local_name(opened[-1].tag) == "part":
                orders[-1][1] += 1
                yield from measure_rows(file, *orders[-1], x)
                opened[-1].remove(x)

    for piece in pieces:
        parser.feed(piece)
        yield from rows()
    parser.close()
    yield from rows()
    if not n_parts:
        raise ValueError("no part")


def broken_file(file: str, error: Exception) -> tuple:
    return (file, *[None] * (len(ELEMENTS) - 2), str(error))


def check(pieces: Iterable[bytes]) -> None:
    """An error if a file doesn't parse or has no part; nothing of it is kept."""
    parser, found = expat.ParserCreate(), []

    def start(name: str, _: dict) -> None:
        if not found and name.rpartition(":")[2] == "part":
            found.append(name)

    parser.StartElementHandler = start
    for piece in pieces:
        parser.Parse(piece)
    parser.Parse(b"", True)
    if not found:
        raise ValueError("no part")


def file_system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class ScoreReader(DataSourceReader):
    def __init__(self, path: str, extensions: tuple[str, ...]):
        self.path, self.extensions = path, extensions

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        shown = lambda x: not any(part[:1] in "._" for part in x.path[len(root) :].strip("/").split("/"))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(self.extensions) and shown(x))
        parts: list[list] = [[]]
        held = 0
        for path, size in files:
            if parts[-1] and held + size > PART:
                parts.append([])
                held = 0
            parts[-1].append((path, path[len(root) :].strip("/")))
            held += max(size, LEAST)
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.path)

        def pieces(path: str) -> Iterator[bytes]:
            with system.open_input_stream(path) as stream:
                while piece := stream.read(PIECE):
                    yield piece

        for path, name in partition.paths:
            with system.open_input_stream(path) as stream:  # a small file is opened once: to check it and to parse it
                head = stream.read(PIECE)
                whole = not stream.read(1)
            again = lambda path=path, head=head, whole=whole: [head] if whole else pieces(path)
            try:
                check(again())
            except (expat.ExpatError, ValueError) as e:
                yield broken_file(name, e)
            else:
                yield from element_rows(name, again())


class ScoreSource(DataSource):
    """Options: ``path``, and ``extensions`` parted by commas (``.xml,.musicxml`` unless given)."""

    @classmethod
    def name(cls) -> str:
        return "scores"

    def schema(self) -> StructType:
        return ELEMENTS

    def reader(self, schema: StructType) -> ScoreReader:
        return ScoreReader(self.options["path"], tuple(self.options.get("extensions", ".xml,.musicxml").split(",")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScoreSource)
