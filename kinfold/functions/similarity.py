"""Similarities of two signatures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equality(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit words."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words; words that one lacks count in full."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(64))), F.lit(0), lambda s, x: s + x)


def image_similarity(pairs: list[tuple[Column, Column]], bits: int = 144) -> Column:
    """The least of the similarities of several hashes (arrays of words) of ``bits`` bits; 0 if any is missing."""
    parts = [1 - hamming_words(a, b) / F.lit(float(bits)) for a, b in pairs]
    worst = parts[0] if len(parts) == 1 else F.least(*parts)
    missing = F.lit(False)
    for a, b in pairs:
        missing = missing | a.isNull() | b.isNull()
    return F.when(missing, 0.0).otherwise(worst)


def parse_image_signature(sig: Column) -> Column:
    """Three base64 hashes joined by bars as an array of binaries; null unless there are exactly three and all decode."""
    parts = F.transform(F.split(sig, r"\|"), lambda x: F.try_to_binary(x, F.lit("base64")))
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda x: x.isNull()) & ~sig.rlike(r"(^|\|)(\||$)"), parts)


def hash_words(raw: Column, n_bytes: int = 18) -> Column:
    """A binary hash as 64-bit words, its last bytes padded with zeros."""
    padded = F.rpad(F.hex(raw), -(-n_bytes // 8) * 16, "0")
    # each half of a word is read on its own: conv has no sign
    half = lambda i, j: F.conv(F.substring(padded, i * 16 + j * 8 + 1, 8), 16, 10).cast("long")
    return F.when(raw.isNotNull(), F.array(*[F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 1)) for i in range(-(-n_bytes // 8))]))


def video_similarity(a: Column, b: Column) -> Column:
    """1 - d / 64, not below 0, for the words of two frame hashes; 0 if one is missing."""
    d = hamming_words(a, b)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(1 - F.least(d / F.lit(64.0), F.lit(1.0)))


def parse_video_signature(sig: Column) -> Column:
    """The JSON signature of a video as struct(hash, src_path, duration); null if it doesn't parse."""
    got = F.from_json(sig, "hash array<bigint>, src_path string, duration int")
    return F.when(got["hash"].isNotNull(), got)


def bigrams(text: Column) -> Column:
    """Neighbouring characters of a text without its white space."""
    chars = F.split(F.regexp_replace(text, r"(?U)\s", ""), "")  # an array, as positions in a string are found by counting from its start
    return F.when(F.size(chars) >= 2, F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda x, y: F.concat(x, y))).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, norms not below 1e-12, cut to [0, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    floor = F.lit(1e-12)
    raw = dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), floor) * F.greatest(F.sqrt(dot(b, b)), floor))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
