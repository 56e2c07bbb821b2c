"""Minimal files of the zipped formats, so that queries and tests have some to read."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OD = "urn:oasis:names:tc:opendocument:xmlns"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def _relations(targets: list[str]) -> str:
    return "<Relationships>" + "".join(
        f'<Relationship Id="rId{i}" Target="{t}"/>' for i, t in enumerate(targets, start=1)
    ) + "</Relationships>"


def docx(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    def paragraph(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def table(rows: list[list[str]]) -> str:
        cells = ("".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) for row in rows)
        return "<w:tbl>" + "".join(f"<w:tr>{c}</w:tr>" for c in cells) + "</w:tbl>"

    # A table stands first, to show that readers put tables after the paragraphs.
    body = "".join(map(table, tables)) + "".join(map(paragraph, paragraphs))
    return zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>'})


def pptx(slides: list[list[str]], table: list[list[str]] = ()) -> bytes:
    def body(text: str) -> str:
        return f"<a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p>"

    def slide(texts: list[str], rows) -> str:
        shapes = "".join(f"<p:sp><p:txBody>{body(t)}</p:txBody></p:sp>" for t in texts)
        if rows:
            cells = (
                "".join(f"<a:tc><a:txBody>{body(c)}</a:txBody></a:tc>" for c in row) for row in rows
            )
            trs = "".join(f"<a:tr>{c}</a:tr>" for c in cells)
            shapes += (
                f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl>{trs}</a:tbl></a:graphicData></a:graphic>"
                "</p:graphicFrame>"
            )
        return (
            f'<p:sld xmlns:p="{_P}" xmlns:a="{_A}"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
        )

    names = [f"slides/slide{i}.xml" for i in range(1, len(slides) + 1)]
    ids = "".join(f'<p:sldId r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{_P}" xmlns:r="{_R}"><p:sldIdLst>{ids}</p:sldIdLst>'
        "</p:presentation>",
        "ppt/_rels/presentation.xml.rels": _relations(names),
    }
    for i, (name, texts) in enumerate(zip(names, slides)):
        parts[f"ppt/{name}"] = slide(texts, table if i == 0 else ())
    return zipped(parts)


def xlsx(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    names = [f"worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)]
    listed = "".join(
        f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, start=1)
    )
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations(names),
    }
    for name, rows in zip(names, sheets.values()):
        data = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
        parts[f"xl/{name}"] = f'<worksheet xmlns="{_S}"><sheetData>{data}</sheetData></worksheet>'
    return zipped(parts)


def _od_content(body: str) -> str:
    spaces = " ".join(f'xmlns:{p}="{_OD}:{p}:1.0"' for p in ("office", "text", "table"))
    return f"<office:document-content {spaces}><office:body>{body}</office:body></office:document-content>"


def odt(paragraphs: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(p)}</text:p>" for p in paragraphs)
    return zipped({"content.xml": _od_content(f"<office:text>{body}</office:text>")})


def ods(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    def cell(value) -> str:
        if value is None:
            return "<table:table-cell/>"
        if isinstance(value, str):
            return f'<table:table-cell office:value-type="string"><text:p>{escape(value)}</text:p></table:table-cell>'
        return f'<table:table-cell office:value-type="float" office:value="{value}"/>'

    body = "".join(
        f'<table:table table:name="{escape(name)}">'
        + "".join(f"<table:table-row>{''.join(map(cell, row))}</table:table-row>" for row in rows)
        + "</table:table>"
        for name, rows in sheets.items()
    )
    return zipped({"content.xml": _od_content(f"<office:spreadsheet>{body}</office:spreadsheet>")})


def epub(chapters: dict[str, str]) -> bytes:
    return zipped({"mimetype": "application/epub+zip", **chapters})
