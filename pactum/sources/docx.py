"""DOCX to text: paragraphs in order, styled or numbered ones as Markdown headings."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pactum.functions.vocab import MAX_DECODED_BYTES

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = "word/document.xml"
_RUN_IN = re.compile(r"\s*(.{2,80}?)[.:]\s+[A-Z(\"“]")


def unsafe(raw: bytes, limit: int = MAX_DECODED_BYTES) -> str | None:
    """Why the document must not be parsed: too large once unpacked, or it declares entities."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            size = z.getinfo(PART).file_size
            if size > limit:
                return f"{PART} unpacks to {size} bytes, above the limit of {limit}"
            with z.open(PART) as f:
                head = f.read(65536)
    except Exception:  # noqa: BLE001  the reader reports what isn't a DOCX at all
        return None
    return "document.xml declares a DTD or entities" if re.search(rb"<!DOCTYPE|<!ENTITY", head, re.IGNORECASE) else None


def is_heading_style(style: str | None) -> bool:
    s = (style or "").lower()
    return "heading" in s or s == "title" or re.fullmatch("h[1-9]", s) is not None


def run_in_title(line: str) -> str | None:
    """The lead of a heading paragraph before its first sentence break; None if that is no title."""
    m = _RUN_IN.match(line)
    title = (m[1] if m else line).strip()
    return title if len(title) <= 70 and len(title.split()) <= 9 else None


def paragraph(line: str, style: str | None, numbered: bool, bold: bool) -> list[str]:
    """Lines for one paragraph."""
    if not line:
        return [""]
    title = run_in_title(line) if numbered or is_heading_style(style) else None
    if title is None:
        return [f"**{line}**" if bold else line]
    return [f"## {title}"] + ([line[len(title) :].lstrip(" .:\t")] if len(title) < len(line) else [])


def read(raw: bytes) -> tuple[str, str]:
    """(text, warning)."""
    why = unsafe(raw)
    if why:
        return "", f"could not parse .docx ({why})"
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read(PART))
    except Exception as e:  # noqa: BLE001  a broken file is a warning
        return "", f"could not parse .docx ({e})"
    lines: list[str] = []
    for p in root.iter(f"{_W}p"):
        props = p.find(f"{_W}pPr")
        style = None if props is None else props.find(f"{_W}pStyle")
        runs = [("".join(t.text or "" for t in r.iter(f"{_W}t")), r.find(f"{_W}rPr/{_W}b") is not None) for r in p.iter(f"{_W}r")]
        runs = [x for x in runs if x[0]]
        name = None if style is None else style.get(f"{_W}val")
        lines += paragraph("".join(t for t, _ in runs).strip(), name, props is not None and props.find(f"{_W}numPr") is not None, all(b for _, b in runs))
    return "\n\n".join(lines), ""
