"""Normalised texts and their signatures, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTEST_BYTES = 10


def decoded(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def normal_text(text: Column) -> Column:
    """White space runs (Unicode) become one space, ends are trimmed; null under 10 bytes."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.octet_length(flat) >= SHORTEST_BYTES, flat)


def normal_code(text: Column) -> Column:
    """Trimmed lines that are not empty and do not open with a comment mark (#, //, /*), joined by a space; null if none is left."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//") & ~x.startswith("/*"))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def signature(normal: Column) -> Column:
    """SHA-256 in hex of a normalised text; null stays null."""
    return F.sha2(normal.cast("binary"), 256)


def text_signature(text: Column, category: Column | str = "document") -> Column:
    """Signature by category: documents and code by their normalised text, archives by their bytes."""
    kind = F.lit(category) if isinstance(category, str) else category
    return F.when(kind == "code", signature(normal_code(text))).when(kind == "archive", F.sha2(text.cast("binary"), 256)).when(kind == "document", signature(normal_text(text)))


def prefix(sig: Column, n: int = 8) -> Column:
    """The blocking key: the first n characters, or all of a shorter signature."""
    return F.substring(sig, 1, n)
