"""Plain .docx and .pptx writers (standard library only): a document for a reader is made on the driver."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return out.getvalue()


def _types(overrides: dict[str, str]) -> str:
    base = f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    return base + "".join(f'<Override PartName="/{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in overrides.items()) + "</Types>"


def _rels(targets: list[tuple[str, str]]) -> str:
    return f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target="{t}"/>' for i, (kind, t) in enumerate(targets, 1)) + "</Relationships>"


def runs(line: str) -> str:
    """`**bold**` parts as bold runs."""
    out = []
    for i, part in enumerate(re.split(r"\*\*(.+?)\*\*", line)):
        if part:
            bold = "<w:rPr><w:b/></w:rPr>" if i % 2 else ""
            out.append(f'<w:r>{bold}<w:t xml:space="preserve">{escape(part)}</w:t></w:r>')
    return "".join(out)


def write_docx(blocks: list[tuple[str, str]]) -> bytes:
    """blocks: (style, text); styles h1 to h3, p, bullet."""
    style = {"h1": "Heading1", "h2": "Heading2", "h3": "Heading3", "bullet": "ListBullet"}
    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style[s]}{chr(34)}/></w:pPr>' if s in style else ''}{runs(t)}</w:p>" for s, t in blocks)
    return _zip({
        "[Content_Types].xml": _types({"word/document.xml": "wordprocessingml.document.main"}),
        "_rels/.rels": _rels([("officeDocument", "word/document.xml")]),
        "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>',
    })


def write_pptx(slides: list[dict]) -> bytes:
    """slides: title, bullets. Titles are title placeholders; bullets are paragraphs of one body shape."""
    names = [f"ppt/slides/slide{i}.xml" for i in range(1, len(slides) + 1)]
    text = lambda lines: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)

    def shape(k, kind, lines):
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="{kind}"/><p:cNvSpPr/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:spPr/><p:txBody><a:bodyPr/>{text(lines)}</p:txBody></p:sp>'

    parts = {
        "[Content_Types].xml": _types({"ppt/presentation.xml": "presentationml.presentation.main"} | dict.fromkeys(names, "presentationml.slide")),
        "_rels/.rels": _rels([("officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{REL}"><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _rels([("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)]),
    }
    for name, s in zip(names, slides):
        parts[name] = f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAW}"><p:cSld><p:spTree>{shape(2, "title", [s["title"]])}{shape(3, "body", s["bullets"])}</p:spTree></p:cSld></p:sld>'
    return _zip(parts)
