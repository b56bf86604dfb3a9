"""What is inside files, read by the tasks that need it.

A scan lists files and probes its cache on path, size and time alone; only rows that miss come here, with their path. Whole contents go to the JVM in batches of bounded size; digests are
taken piece by piece, so a file of any size passes; of images only the head is read for size and camera data. Local paths are opened, others go through Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.paths import local_path
from kinfold.sources.extract import dimensions, has_camera_data

#: Bytes of files handed on together; a larger file goes alone.
BATCH_BYTES = 32 << 20
#: Bytes of an image's head: its size and camera data lie there.
HEAD_BYTES = 1 << 20


def opened(path: str):
    """A readable binary stream of a path or URI; an OSError if there is none."""
    path = local_path(path)
    if path.startswith("/"):
        return open(path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _read(path: str, n: int = -1) -> bytes | None:
    try:
        with opened(path) as f:
            return f.read(n) if n >= 0 else f.read()
    except (OSError, pa.ArrowException):
        return None


def _digest(path: str) -> str | None:
    try:
        with opened(path) as f:
            h = hashlib.sha256()
            while piece := f.read(1 << 20):
                h.update(piece)
        return h.hexdigest()
    except (OSError, pa.ArrowException):
        return None


def with_content(files: DataFrame) -> DataFrame:
    """``files`` (path, size, ...) with ``content``, null for what cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            place = batch.schema.get_field_index("path")
            held, size, lo = [], 0, 0
            for i, path in enumerate(batch.column(place).to_pylist()):
                held.append(_read(path))
                size += len(held[-1] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, i + 1 - lo).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])
                    held, size, lo = [], 0, i + 1
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(lo).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])

    return files.mapInArrow(run, files.select("*", F.lit(None).cast("binary").alias("content")).schema)


def _mapped(files: DataFrame, one, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``files`` with columns that a function makes of each path."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = [one(p) for p in batch.column(batch.schema.get_field_index("path")).to_pylist()]
            new = [pa.array([g[i] for g in got], t) for i, t in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    typed = [F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in schema.split(", ")]
    return files.mapInArrow(run, files.select("*", *typed).schema)


def with_digest(files: DataFrame) -> DataFrame:
    """``files`` with ``digest``, the SHA-256 of their bytes in hex."""
    return _mapped(files, lambda p: (_digest(p),), {"digest": pa.string()}, "digest string")


def with_head_facts(images: DataFrame) -> DataFrame:
    """``images`` with width, height and has_exif, from the head of each file."""

    def one(path: str):
        head = _read(path, HEAD_BYTES) or b""
        size = dimensions(head)
        return (*(size or (None, None)), has_camera_data(head))

    return _mapped(images, one, {"width": pa.int32(), "height": pa.int32(), "has_exif": pa.bool_()}, "width int, height int, has_exif boolean")


def copied(files: DataFrame, folder: str) -> DataFrame:
    """Copies of ``files`` below ``folder`` under names that readers list: path, copy (the copy's name). For files whose own names begin with a point or an underscore."""

    def one(path: str):
        name = hashlib.sha1(path.encode()).hexdigest() + os.path.splitext(path)[1].lower()
        data = _read(path)
        if data is None:
            return (None,)
        at = local_path(folder)
        if at.startswith("/"):
            os.makedirs(at, exist_ok=True)
            part = f"{at}/.{name}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{at}/{name}")  # a task done twice leaves one whole file
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(at)
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(data)
        return (name,)

    return _mapped(files.select("path"), one, {"copy": pa.string()}, "copy string").filter("copy is not null")
