"""Spreadsheets as a Spark data source (format "xlsx"): inline strings, text cells.

Writing: each task writes one part file of a folder; rows keep their order within the task. A manifest, put in its place as a whole, names the files that
count: until then readers see the old ones, from then on the new ones, whenever a driver or task is lost; old files go last. Reading: files are
dealt to tasks, each streams one sheet (option `sheet`, else the first). A path is a file, a folder or a glob below a
folder that the driver and all tasks have mounted; books of several sheets are made as bytes by operators.workbook.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import uuid
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
_LINK = '<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
_BOOK = '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>'
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def number(cell: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def _text(v) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))


def _zipped(sheets, structures: dict | None = None) -> bytes:
    """A file of (name, rows) sheets; rows: (number, [(letters, value)]) in order. structures: by sheet, columns as (first, last, width, hidden) by number and merged ranges like A1:B2."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = []
        for k, (name, rows) in enumerate(sheets, 1):
            names.append(escape(name[:31], {'"': "&quot;"}))
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                columns, merged = (structures or {}).get(name, ((), ()))
                f.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">')
                if columns:
                    f.write(("<cols>" + "".join(f'<col min="{a}" max="{b}"' + ("" if w is None else f' width="{w}" customWidth="1"') + (' hidden="1"' if h else "") + "/>" for a, b, w, h in columns) + "</cols>").encode())
                f.write(b"<sheetData>")
                for r, row in rows:
                    cells = "".join(f'<c r="{c}{r}" t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>' for c, v in row if v is not None)
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData>")
                if merged:
                    f.write((f'<mergeCells count="{len(merged)}">' + "".join(f'<mergeCell ref="{m}"/>' for m in merged) + "</mergeCells>").encode())
                f.write(b"</worksheet>")
        part = '<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        z.writestr("[Content_Types].xml", _TYPES.format(sheets="".join(part.format(k=k) for k in range(1, len(names) + 1))))
        z.writestr("_rels/.rels", _RELS.format(links=_LINK.format(k=1, kind="officeDocument", target="xl/workbook.xml")))
        z.writestr("xl/workbook.xml", _BOOK.format(sheets="".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format(links="".join(_LINK.format(k=k, kind="worksheet", target=f"worksheets/sheet{k}.xml") for k in range(1, len(names) + 1))))
    return out.getvalue()


def workbook(header: list[str], rows, sheet: str = "Sheet1") -> bytes:
    """A file of one sheet: a header and rows of values."""
    lettered = lambda row: [(letters(c), v) for c, v in enumerate(row, 1)]
    return _zipped([(sheet, ((r, lettered(row)) for r, row in enumerate(_chain(header, rows), 1)))])


def book(sheets: list[tuple[str, list[tuple[int, str, str]]]], structures: dict | None = None) -> bytes:
    """A file of several sheets, each a list of (row, letters, value) in any order."""

    def rows(cells):
        by_row: dict[int, list] = {}
        for r, c, v in cells:
            by_row.setdefault(r, []).append((number(c), c, v))
        for r in sorted(by_row):
            yield r, [(c, v) for _, c, v in sorted(by_row[r], key=lambda x: x[0])]

    return _zipped([(name, rows(cells)) for name, cells in sheets], structures)


def _chain(header, rows):
    yield header
    yield from rows


def sheet_parts(z: zipfile.ZipFile) -> dict[str, str]:
    """The part of the file that holds each sheet, by the sheet's name, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
    sheets = ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(NS + "sheet")
    return {s.get("name"): (t.lstrip("/") if (t := targets[s.get(_R + "id")]).startswith("/") else f"xl/{t}") for s in sheets}


def resolved(names: list[str], wanted: str | None) -> str:
    """The sheet that is meant: by its name, by its name whatever the case and spaces around it, or the first if none is asked for."""
    if not names:
        raise ValueError("the workbook has no sheet")
    if wanted is None:
        return names[0]
    alike = [n for n in names if n == wanted] or [n for n in names if n.strip().lower() == wanted.strip().lower()]
    if not alike:
        raise ValueError(f"no sheet {wanted!r} among {names}")
    return alike[0]


def cells(path, sheet: str | None = None):
    """Rows of one sheet as lists of text or None."""
    with zipfile.ZipFile(path) as z:
        parts = sheet_parts(z)
        part = parts[resolved(list(parts), sheet)]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(NS + "t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        for _, row in ElementTree.iterparse(z.open(part)):
            if row.tag == NS + "row":
                out = []
                for c in row:
                    k = number(c.get("r", letters(len(out) + 1)))
                    out += [None] * (k - len(out))
                    v = c.find(NS + "v")
                    out[k - 1] = "".join(t.text or "" for t in c.iter(NS + "t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                yield out
                row.clear()


STRUCTURE = "file string, sheet string, sheet_position int, kind string, row1 int, col1 int, row2 int, col2 int, text string, width double, hidden boolean"


def structure(path):
    """All sheets' columns, cells and merged ranges, in the order of the file: (sheet, its place, kind, row1, col1, row2, col2, text, width, hidden).

    Rows are read one after the other; a sheet's cells are never held together.
    """
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if si.tag == NS + "si":
                    shared.append("".join(t.text or "" for t in si.iter(NS + "t")))
                    si.clear()
        for place, (name, part) in enumerate(sheet_parts(z).items(), 1):
            for _, e in ElementTree.iterparse(z.open(part)):
                if e.tag == NS + "col":
                    width = e.get("width")
                    yield name, place, "column", None, int(e.get("min")), None, int(e.get("max")), None, None if width is None else float(width), e.get("hidden") in ("1", "true") or width is not None and float(width) == 0
                elif e.tag == NS + "mergeCell":
                    first, _, last = e.get("ref").partition(":")
                    (c1, r1), (c2, r2) = ((number(x), int(re.search(r"[0-9]+", x)[0])) for x in (first, last or first))
                    yield name, place, "merge", r1, c1, r2, c2, e.get("ref"), None, None
                elif e.tag == NS + "row":
                    r = int(e.get("r"))
                    for k, c in enumerate(e, 1):
                        v, kind = c.find(NS + "v"), c.get("t")
                        text = "".join(t.text or "" for t in c.iter(NS + "t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                        if text is not None:
                            col = number(c.get("r", letters(k)))
                            yield name, place, "cell", r, col, r, col, text, None, None
                    e.clear()


class XlsxStructure(DataSource):
    """Format "xlsx_structure": what `structure` gives of each file, one task a file."""

    @classmethod
    def name(cls):
        return "xlsx_structure"

    def schema(self):
        return STRUCTURE

    def reader(self, schema: StructType):
        return StructureReader(XlsxSource(self.options).files())


class StructureReader(DataSourceReader):
    def __init__(self, files):
        self.paths = files

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for row in structure(partition.value):
            yield (os.path.basename(partition.value), *row)


MANIFEST = "_committed.json"


def committed(folder: str) -> list[str]:
    """Names of the files of a folder that count: those of its manifest, or all if it has none."""
    path = os.path.join(folder, MANIFEST)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return sorted(json.load(f))
    return sorted(map(os.path.basename, glob.glob(os.path.join(folder, "*.xlsx"))))


def commit_files(folder: str, names: list[str]) -> None:
    draft = os.path.join(folder, f"{MANIFEST}.{uuid.uuid4().hex}")
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(sorted(names), f)
    os.replace(draft, os.path.join(folder, MANIFEST))


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def files(self):
        p = self.options["path"].removeprefix("file:")
        return [os.path.join(p, n) for n in committed(p)] if os.path.isdir(p) else sorted(glob.glob(p))

    def schema(self):
        files = self.files()
        if not files:
            raise FileNotFoundError(f"no xlsx file in {self.options['path']!r}")
        header = next(iter(cells(files[0], self.options.get("sheet"))), [])
        return ", ".join(f"`{(h or letters(k)).replace('`', '')}` string" for k, h in enumerate(header, 1))

    def reader(self, schema: StructType):
        return XlsxReader(self.files(), len(schema.fields), self.options.get("sheet"))

    def writer(self, schema: StructType, overwrite: bool):
        return XlsxWriter(self.options, schema.names, overwrite)


class XlsxReader(DataSourceReader):
    def __init__(self, files, width, sheet):
        self.paths, self.width, self.sheet = files, width, sheet

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        rows = cells(partition.value, self.sheet)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self.width)[: self.width])


class XlsxWriter(DataSourceWriter):
    def __init__(self, options, names, overwrite):
        self.path, self.sheet, self.names, self.overwrite = options["path"].removeprefix("file:"), options.get("sheet", "Sheet1"), names, overwrite

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f"part-{uuid.uuid4().hex}.xlsx")
        with open(target + ".tmp", "wb") as f:
            f.write(workbook(self.names, (tuple(r) for r in rows), self.sheet))
        message = WriterCommitMessage()
        message.path = target
        return message

    def commit(self, messages):
        os.makedirs(self.path, exist_ok=True)
        old = committed(self.path)
        commit_files(self.path, old)  # a folder without a manifest keeps what it has while new files take their names
        new = [m.path for m in messages if m is not None]
        for path in new:
            os.replace(path + ".tmp", path)
        names = [os.path.basename(p) for p in new]
        commit_files(self.path, names if self.overwrite else [*old, *names])
        for name in old if self.overwrite else []:
            if os.path.exists(os.path.join(self.path, name)):
                os.remove(os.path.join(self.path, name))

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")
