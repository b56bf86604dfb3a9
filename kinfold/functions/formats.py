"""Texts for people: sizes, durations, list lines, CSV fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    """A number with so many digits (2 at most), rounded by its binary value as C's printf does: 1.15 lies below the half, and only exact halves go to the even digit.

    A plain format and ``bround`` read the shortest decimal instead. Only where the rounded product is a half does the part that it lost (exact by Veltkamp's split) decide.
    """
    x = x.cast("double")
    scaled = x * F.lit(float(10**places))
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    lost = (high * F.lit(float(10**places)) - scaled) + (x - high) * F.lit(float(10**places))
    half = F.abs(scaled - F.rint(scaled)) == 0.5
    whole = F.rint(F.when(half, scaled + F.signum(lost) * 0.25).otherwise(scaled))
    return F.format_string(f"%.{places}f", whole / F.lit(float(10**places)))


def _sized(n: Column, base: float, digits: tuple[int, int, int]) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, (unit, places) in enumerate(zip(("KB", "MB", "GB"), digits, strict=True), 1):
        out = F.when(n >= base**power, F.concat(fixed(n / F.lit(base**power), places), F.lit(f" {unit}"))).otherwise(out)
    return out


def binary_size(n: Column) -> Column:
    """Sizes by 1024."""
    return _sized(n, 1024.0, (1, 2, 2))


def decimal_size(n: Column) -> Column:
    """Sizes by 1000."""
    return _sized(n, 1000.0, (0, 1, 1))


def duration(seconds: Column, gap: str = "") -> Column:
    """h, m and s as far as needed; ``gap`` between the parts ("" on the command line, " " on screen)."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60)), s % 60
    return F.when(h > 0, F.format_string(f"%dh{gap}%02dm{gap}%02ds", h, m, r)).when(m > 0, F.format_string(f"%dm{gap}%02ds", m, r)).otherwise(F.concat(s.cast("string"), F.lit("s")))


def megabytes(n: Column) -> Column:
    return F.concat(fixed(n / F.lit(1048576.0), 2), F.lit(" MB"))


def quoted(text: Column) -> Column:
    """A CSV field in quotes, inner quotes doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def session_line(row_id: Column, status: Column, created: Column, name: Column) -> Column:
    return F.concat_ws(" ", F.rpad(row_id.cast("string"), 6, " "), F.rpad(status, 12, " "), F.rpad(created, 22, " "), name)


def group_line(row_id: Column, kind: Column, similarity: Column) -> Column:
    return F.format_string("Group %d [%s] - %s%% similar", row_id, kind, fixed(similarity * 100, 1))


def delete_line(path: Column, size: Column, group: Column, similarity: Column) -> Column:
    return F.format_string("Would delete: %s (%s) [group %d - %s%% similar]", path, megabytes(size), group, fixed(similarity * 100, 1))
