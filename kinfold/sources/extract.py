"""What is inside a file: text of documents, kind by first bytes, size of images, camera data."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = ("txt", "srt", "vtt", "sub", "rtf")
# Leading bytes in hex, kind; the first that fits wins.
MAGIC = (("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424d", "image/bmp"), ("49492a00", "image/tiff"), ("4d4d002a", "image/tiff"), ("255044462d", "application/pdf"), ("504b0304", "application/zip"), ("1f8b", "application/gzip"), ("425a68", "application/x-bzip2"), ("fd377a585a00", "application/x-xz"), ("377abcaf271c", "application/x-7z-compressed"), ("526172211a07", "application/vnd.rar"), ("28b52ffd", "application/zstd"), ("1a45dfa3", "video/x-matroska"), ("464c5601", "video/x-flv"))
# Kind by extension where the bytes tell none.
BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tiff": "image/tiff", "svg": "image/svg+xml", "txt": "text/plain", "pdf": "application/pdf", "rtf": "application/rtf", "html": "text/html", "css": "text/css", "js": "text/javascript", "py": "text/x-python", "mp4": "video/mp4", "webm": "video/webm", "mov": "video/quicktime", "avi": "video/x-msvideo", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar"}


def mime_type(content: Column, ext: Column) -> Column:
    """Kind by leading bytes, else by extension, else null."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "41564920"), "video/x-msvideo").when(F.substring(head, 9, 8) == "66747970", "video/mp4")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    known = F.create_map(*[x for k, v in BY_EXTENSION.items() for x in (F.lit(k), F.lit(v))])
    return out.otherwise(F.try_element_at(known, F.coalesce(F.lower(ext), F.lit(""))))


def _document_text(content: bytes, member: str, text_in: str, newline_after: str) -> str | None:
    """Text inside ``text_in`` elements of a zipped XML member, a line end after each ``newline_after``. XML that breaks off gives the text before the break."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            raw = z.read(member)
    except (zipfile.BadZipFile, KeyError, OSError, EOFError, NotImplementedError, RuntimeError, zlib.error):
        return None
    parts: list[str] = []
    depth = 0  # of text_in elements around the place

    def start(name: str, _attributes) -> None:
        nonlocal depth
        depth += name.rsplit("}", 1)[-1] == text_in

    def end(name: str) -> None:
        nonlocal depth
        name = name.rsplit("}", 1)[-1]
        depth -= name == text_in
        if name == newline_after:
            parts.append("\n")

    def characters(data: str) -> None:
        if depth:
            parts.append(data)

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        pass
    text = "".join(parts)
    return text if text.strip() else None


def docx_text(content: bytes) -> str | None:
    return _document_text(content, "word/document.xml", "t", "p")


def odt_text(content: bytes) -> str | None:
    return _document_text(content, "content.xml", "p", "p")


def pdf_text(content: bytes) -> str | None:
    """Text of a PDF if the optional ``pypdf`` is installed, else None."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages) or None
    except Exception:  # a broken file has no text
        return None


READERS = {"docx": docx_text, "doc": docx_text, "odt": odt_text, "pdf": pdf_text}


@F.pandas_udf(T.StringType())
def packed_text(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([READERS[e](c) if c is not None and e in READERS else None for c, e in zip(content, ext, strict=True)], dtype=object)


# ---------------------------------------------------------------- images


#: TIFF tags of width and height.
_SIDES = (0x0100, 0x0101)


def dimensions(content: bytes) -> tuple[int, int] | None:
    """Width and height from the head of PNG, GIF, BMP, JPEG, WebP and TIFF files."""
    try:
        if content[:4] in (b"II*\x00", b"MM\x00*"):
            order = "<" if content[:2] == b"II" else ">"
            tags = _tags(content, struct.unpack_from(order + "I", content, 4)[0], order)
            sides = [struct.unpack(order + ("H" if tags[t][0] == 3 else "I"), tags[t][2][: 2 if tags[t][0] == 3 else 4])[0] for t in _SIDES if t in tags and tags[t][0] in (3, 4)]
            return tuple(sides) if len(sides) == 2 else None
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", content[16:24])
        if content[:3] == b"GIF":
            return struct.unpack("<HH", content[6:10])
        if content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            return w, abs(h)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            if content[12:16] == b"VP8X":
                return int.from_bytes(content[24:27], "little") + 1, int.from_bytes(content[27:30], "little") + 1
            if content[12:16] == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            return tuple(x & 0x3FFF for x in struct.unpack("<HH", content[26:30]))
        if content[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(content):
                if content[at] != 0xFF:
                    at += 1
                    continue
                mark = content[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return w, h
                at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    except struct.error:
        return None
    return None


#: EXIF tags of maker, model, software; the pointers to the EXIF and GPS blocks; latitude and focal length in those.
_MAKE, _MODEL, _SOFTWARE, _EXIF, _GPS, _LATITUDE, _FOCAL = 0x010F, 0x0110, 0x0131, 0x8769, 0x8825, 0x0002, 0x920A


def _tags(tiff: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    n = struct.unpack_from(order + "H", tiff, at)[0]
    return {tag: (kind, count, tiff[at + 10 + 12 * i : at + 14 + 12 * i]) for i in range(n) for tag, kind, count in [struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * i)]}


def has_camera_data(content: bytes) -> bool:
    """Maker, model, latitude or focal length is there, or the software's name holds ``scan``."""
    at = content.find(b"Exif\x00\x00")
    tiff = content[at + 6 :] if at >= 0 else content if content[:4] in (b"II*\x00", b"MM\x00*") else b""
    try:
        if len(tiff) < 8:
            return False
        order = "<" if tiff[:2] == b"II" else ">"
        main = _tags(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
        if _MAKE in main or _MODEL in main:
            return True
        for pointer, tag in ((_EXIF, _FOCAL), (_GPS, _LATITUDE)):
            if pointer in main and tag in _tags(tiff, struct.unpack(order + "I", main[pointer][2])[0], order):
                return True
        if _SOFTWARE in main:
            _, count, raw = main[_SOFTWARE]
            text = raw[:count] if count <= 4 else tiff[struct.unpack(order + "I", raw)[0] :][:count]
            return b"scan" in text.lower()
    except struct.error:
        return False
    return False
