"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.schema import CATEGORIES, EXCLUDED_DIRS, EXTENSIONS


def local_path(path: str) -> str:
    """A path of the local file system without its scheme; others as they are."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def plain_path(path: Column) -> Column:
    """``local_path`` of a column."""
    return F.regexp_replace(path, "^file:/+", "/")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(name: Column) -> Column:
    """Lower-cased text after the last point; null without one or when the only point leads the name."""
    return F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)), F.lit(""))


def category(ext: Column) -> Column:
    """The category of an extension in any case; null for an unknown one."""
    out = None
    for name, exts in EXTENSIONS.items():
        hit = F.lower(ext).isin(*exts)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def in_excluded_dir(path: Column) -> Column:
    """True if any directory of the path (its last part is the file) is on the list of skipped names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, EXCLUDED_DIRS)))


def parse_categories(labels: list[str]) -> list[str]:
    """Known labels in order of the categories; unknown ones are dropped, none left is an error."""
    out = [c for c in CATEGORIES if c in {x.strip().lower() for x in labels}]
    if not out:
        raise ValueError(f"no known file type in {labels}; known: {', '.join(CATEGORIES)}")
    return out
