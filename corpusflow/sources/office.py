"""Text and cells of zipped office formats, read from their XML parts."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_ODTEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


class Package:
    """The parts of a zipped document, with relationship lookup."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def targets(self, part: str) -> dict[str, str]:
        folder, base = posixpath.split(part)
        rels = f"{folder}/_rels/{base}.rels"
        if rels not in self.names:
            return {}
        return {
            r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/")
            for r in self.xml(rels)
        }


def _row_line(cells) -> str:
    return " | ".join(c.strip() for c in cells if c.strip())


# ---- word processing ------------------------------------------------------------------------------------


def _run_text(run) -> str:
    out = []
    for part in run:
        if part.tag == _W + "t":
            out.append(part.text or "")
        elif part.tag in (_W + "tab", _W + "ptab"):
            out.append("\t")
        elif part.tag == _W + "cr" or (
            part.tag == _W + "br" and part.get(_W + "type", "textWrapping") == "textWrapping"
        ):
            out.append("\n")
        elif part.tag == _W + "noBreakHyphen":
            out.append("-")
    return "".join(out)


def _paragraph_text(paragraph) -> str:
    out = []
    for child in paragraph:
        if child.tag == _W + "r":
            out.append(_run_text(child))
        elif child.tag == _W + "hyperlink":
            out.extend(_run_text(r) for r in child.findall(_W + "r"))
    return "".join(out)


def _word_rows(table):
    """Cell texts per row; a cell spanning columns repeats, a vertically merged one repeats the cell above."""
    above: dict[int, str] = {}
    for row in table.findall(_W + "tr"):
        cells, column, current = [], 0, {}
        for cell in row.findall(_W + "tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            width = int(span.get(_W + "val")) if span is not None else 1
            if merge is not None and merge.get(_W + "val", "continue") == "continue":
                text = above.get(column, "")
            else:
                text = "\n".join(_paragraph_text(p) for p in cell.findall(_W + "p"))
            cells.extend([text] * width)
            current[column] = text
            column += width
        above = current
        yield cells


def docx_text(content: bytes) -> str:
    body = Package(content).xml("word/document.xml").find(_W + "body")
    lines = [_paragraph_text(p).strip() for p in body.findall(_W + "p")]
    for table in body.findall(_W + "tbl"):
        lines.extend(_row_line(cells) for cells in _word_rows(table))
    return "\n".join(line for line in lines if line)


# ---- presentations --------------------------------------------------------------------------------------


def _drawing_text(body) -> str:
    paragraphs = []
    for paragraph in body.findall(_A + "p"):
        out = []
        for child in paragraph:
            if child.tag in (_A + "r", _A + "fld"):
                out.append(child.findtext(_A + "t") or "")
            elif child.tag == _A + "br":
                out.append("\v")
        paragraphs.append("".join(out))
    return "\n".join(paragraphs)


def pptx_slides(content: bytes) -> list[str]:
    package = Package(content)
    part = "ppt/presentation.xml"
    targets = package.targets(part)
    slides = []
    for ref in package.xml(part).iterfind(f"{_P}sldIdLst/{_P}sldId"):
        lines = []
        for shape in package.xml(targets[ref.get(_REL + "id")]).find(f"{_P}cSld/{_P}spTree"):
            if shape.tag == _P + "sp" and (body := shape.find(_P + "txBody")) is not None:
                lines.append(_drawing_text(body).strip())
            for row in shape.iterfind(f"{_A}graphic/{_A}graphicData/{_A}tbl/{_A}tr"):
                bodies = (cell.find(_A + "txBody") for cell in row.findall(_A + "tc"))
                lines.append(_row_line(_drawing_text(b) for b in bodies if b is not None))
        slides.append("\n".join(line for line in lines if line))
    return slides


# ---- spreadsheets ---------------------------------------------------------------------------------------

# Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def number_text(raw: str) -> str:
    value = float(raw)
    return str(int(value)) if value.is_integer() else repr(value)


def _moment_text(serial: float, epoch: datetime) -> str:
    moment = epoch + timedelta(seconds=round(serial * 86400))
    return str(moment.date()) if serial >= 1 and serial == int(serial) else str(moment if serial >= 1 else moment.time())


def _date_styles(package: Package) -> set[int]:
    if "xl/styles.xml" not in package.names:
        return set()
    styles = package.xml("xl/styles.xml")
    dated = set(_DATE_FORMATS)
    for fmt in styles.iterfind(f"{_S}numFmts/{_S}numFmt"):
        bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", fmt.get("formatCode", ""))
        if re.search("[dmhysDMHYS]", bare):
            dated.add(int(fmt.get("numFmtId")))
    return {
        i for i, xf in enumerate(styles.iterfind(f"{_S}cellXfs/{_S}xf")) if int(xf.get("numFmtId", "0")) in dated
    }


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _string_item(item) -> str:
    """Plain or rich text, without phonetic hints."""
    return "".join(t.text or "" for part in item if part.tag != _S + "rPh" for t in part.iter(_S + "t"))


def xlsx_sheets(content: bytes):
    """(name, rows) per sheet; a row is a dict of column number to text, in sheet order."""
    package = Package(content)
    part = "xl/workbook.xml"
    workbook, targets = package.xml(part), package.targets(part)
    shared = []
    if "xl/sharedStrings.xml" in package.names:
        shared = [_string_item(i) for i in package.xml("xl/sharedStrings.xml").findall(_S + "si")]
    dated = _date_styles(package)
    flags = workbook.find(_S + "workbookPr")
    old_mac = flags is not None and flags.get("date1904") in ("1", "true")
    epoch = datetime(1904, 1, 1) if old_mac else datetime(1899, 12, 30)

    def cell_text(cell) -> str:
        kind, raw = cell.get("t", "n"), cell.findtext(_S + "v")
        if kind == "inlineStr":
            inline = cell.find(_S + "is")
            return _string_item(inline) if inline is not None else ""
        if raw is None or kind == "e":
            return ""
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "n":
            return _moment_text(float(raw), epoch) if int(cell.get("s", "0")) in dated else number_text(raw)
        return raw

    def rows(sheet):
        number = 0
        for row in sheet.iterfind(f"{_S}sheetData/{_S}row"):
            number = int(row.get("r", number + 1))
            cells, column = {}, -1
            for cell in row.findall(_S + "c"):
                column = _column_number(cell.get("r")) if cell.get("r") else column + 1
                cells[column] = cell_text(cell)
            yield number - 1, cells

    for sheet in workbook.iterfind(f"{_S}sheets/{_S}sheet"):
        yield sheet.get("name"), rows(package.xml(targets[sheet.get(_REL + "id")]))


def _ods_cell(cell) -> str:
    kind = cell.get(_OFFICE + "value-type")
    if kind in ("float", "percentage", "currency"):
        return number_text(cell.get(_OFFICE + "value"))
    if kind == "boolean":
        return "True" if cell.get(_OFFICE + "boolean-value") == "true" else "False"
    if kind == "date":
        value = cell.get(_OFFICE + "date-value")
        return value.replace("T", " ").removesuffix(" 00:00:00")
    return "\n".join(_ods_paragraph(p) for p in cell.findall(_ODTEXT + "p"))


def _ods_paragraph(node) -> str:
    out = [node.text or ""]
    for child in node:
        if child.tag == _ODTEXT + "s":
            out.append(" " * int(child.get(_ODTEXT + "c", "1")))
        elif child.tag == _ODTEXT + "tab":
            out.append("\t")
        elif child.tag == _ODTEXT + "line-break":
            out.append("\n")
        else:
            out.append(_ods_paragraph(child))
        out.append(child.tail or "")
    return "".join(out)


def ods_sheets(content: bytes):
    """As ``xlsx_sheets``. A repeated blank row or cell only moves the position on."""

    def rows(table):
        number = 0
        for row in table.iter(_TABLE + "table-row"):
            cells, column = {}, 0
            for cell in row:
                if cell.tag not in (_TABLE + "table-cell", _TABLE + "covered-table-cell"):
                    continue
                width = int(cell.get(_TABLE + "number-columns-repeated", "1"))
                text = _ods_cell(cell)
                if text:
                    cells.update((column + i, text) for i in range(width))
                column += width
            times = int(row.get(_TABLE + "number-rows-repeated", "1"))
            if cells:
                for i in range(times):
                    yield number + i, cells
            number += times

    for table in Package(content).xml("content.xml").iter(_TABLE + "table"):
        yield table.get(_TABLE + "name"), rows(table)
