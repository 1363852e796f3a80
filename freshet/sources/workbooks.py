"""Workbooks as a Python data source: one partition per sheet, rows streamed from its XML.

``spark.read.format("workbook").load(folder)`` gives (path, sheet, row, cells) of every sheet of
every ``.xlsx`` file whose name holds the option ``name`` (in any case), in a folder and those below
it.  A sheet is read element by element, so a task holds one row, and the workbook's shared strings.
Files that are no workbooks, and sheets whose XML breaks off, give what could be read of them.

Paths are opened by pyarrow's file systems, so a URI names any store that they know; a plain path
is a local or mounted folder that all executors see.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SHEET_FILE = re.compile(r"xl/worksheets/[^/]+\.xml$")
SCHEMA = "path string, sheet string, row long, cells array<string>"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _opened(path: str) -> zipfile.ZipFile:
    store, place = _store(path)
    return zipfile.ZipFile(store.open_input_file(place))


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as source:
        for _, item in ElementTree.iterparse(source):
            if item.tag == _SHEET + "si":
                found.append("".join(t.text or "" for t in item.iter(_SHEET + "t")))
                item.clear()
    return found


def _place(name: str) -> int:
    """Number of a cell's column from its letters."""
    at = 0
    for ch in re.match(r"[A-Z]*", name)[0]:
        at = at * 26 + ord(ch) - 64
    return at - 1


def sheet_rows(book: zipfile.ZipFile, sheet: str, shared: list[str]) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts; cells that are left out are missing values."""
    with book.open(sheet) as source:
        for _, row in ElementTree.iterparse(source):
            if row.tag != _SHEET + "row":
                continue
            cells: dict[int, str | None] = {}
            for c in row.iter(_SHEET + "c"):
                value, kind, at = c.find(_SHEET + "v"), c.get("t"), _place(c.get("r", ""))
                text = "".join(t.text or "" for t in c.iter(_SHEET + "t")) if kind == "inlineStr" else None if value is None else value.text
                if kind == "s" and text is not None:
                    text = shared[int(text)] if int(text) < len(shared) else None
                cells[at if at >= 0 else len(cells)] = text
            row.clear()
            yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]


class Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name.lower()

    def partitions(self) -> list[Sheet]:
        """Sheets of the workbooks; only the files' directories are read here."""
        from pyarrow import fs

        store, place = _store(self.path)
        files = [x.path for x in store.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)) if x.is_file]
        head = self.path[: len(self.path) - len(place)] if self.path.endswith(place) else ""
        found = []
        for path in sorted(files):
            base = path.rsplit("/", 1)[-1].lower()
            if base.endswith(".xlsx") and self.name in base and not base.startswith("~$"):
                try:
                    with _opened(head + path) as book:
                        found += [Sheet(head + path, n) for n in sorted(book.namelist()) if _SHEET_FILE.match(n)]
                except (zipfile.BadZipFile, OSError, ValueError):
                    continue
        return found

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        if partition is None:  # there are no sheets
            return
        with _opened(partition.path) as book:
            shared = shared_strings(book)
            rows = enumerate(sheet_rows(book, partition.sheet, shared))
            while True:
                try:
                    number, cells = next(rows)
                except (StopIteration, ElementTree.ParseError, zipfile.BadZipFile, EOFError, ValueError):
                    return
                yield partition.path, partition.sheet, number, cells


class WorkbookSource(DataSource):
    """Options: path, and name (a part of the files' names)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("name", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
