"""Spreadsheets: a writer whose tasks write a sheet's rows as XML parts, which the commit puts into one file."""

from __future__ import annotations

import datetime
import decimal
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Most rows of a sheet, with its heading, and most characters of a cell.
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _files(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _cell(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)) and abs(value) != math.inf:
        return f"<c><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"<c><v>{value}</v></c>"
    text = value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)
    if len(text) > MOST_CHARS:
        raise ValueError(f"a cell holds at most {MOST_CHARS} characters, this value has {len(text)}")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", text))}</t></is></c>'


def _row(values) -> bytes:
    return ("<row>" + "".join(map(_cell, values)) + "</row>").encode()


@dataclass
class _Part(WriterCommitMessage):
    place: int
    path: str
    rows: int


class SheetWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.sheet, self.names = options["path"], options.get("sheet", "scores"), schema.names
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        files, folder = _files(self.parts)
        files.create_dir(folder, recursive=True)  # here and not in tasks: one that ends after an abort must not make it again

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, folder = _files(self.parts)
        place, rows = TaskContext.get().partitionId(), 0
        path = f"{folder}/{place:06d}-{uuid.uuid4().hex}.xml"  # another attempt of the task writes another file
        with files.open_output_stream(path) as out:
            for r in iterator:
                out.write(_row(r))
                rows += 1
        return _Part(place, path, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        if sum(m.rows for m in parts) + 1 > MOST_ROWS:
            self.abort(messages)
            raise ValueError(f"a sheet holds at most {MOST_ROWS - 1} rows and a heading")
        files, target = _files(self.path)
        with files.open_output_stream(target) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            for name, text in self._frame().items():
                out.writestr(name, _HEAD + text)
            with out.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write((_HEAD + f'<worksheet xmlns="{_MAIN}"><sheetData>').encode())
                sheet.write(_row(self.names))
                for m in parts:
                    with files.open_input_stream(m.path) as part:
                        while piece := part.read(1 << 20):
                            sheet.write(piece)
                sheet.write(b"</sheetData></worksheet>")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Removes the parts."""
        from pyarrow import fs

        files, folder = _files(self.parts)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)

    def _frame(self) -> dict[str, str]:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        return {
            "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK}"><sheets><sheet name={quoteattr(self.sheet[:31])} sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_LINK}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        }


class SheetSource(DataSource):
    """Format ``sheet``: write only; options path and sheet."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(self.options, schema)


def write_sheet(df: DataFrame, path: str, sheet: str = "scores") -> None:
    """One spreadsheet with one sheet, rows in the order of ``df``; a file at that path is replaced.

    Tasks write their rows as XML beside the target, and the commit streams the parts into the file, so neither holds the
    table.  Nulls and NaN are empty cells, arrays and structs their text.  Too many rows or a too long cell
    is an error, and no file is left.  The path must be one that the driver and all executors see.
    """
    spark = df.sparkSession
    spark.dataSource.register(SheetSource)
    df.write.format("sheet").option("sheet", sheet).mode("append").save(path)
