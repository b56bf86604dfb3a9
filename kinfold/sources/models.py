"""Model files on disk and settings: plain configuration, no Spark."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import numpy as np

from kinfold.schema import IMAGE_CLASSES

# The one known model, its files, the width of its vectors.
MODELS = {"clip-vit-b32": {"name": "CLIP ViT-B/32", "files": ("clip_image.onnx", "clip_prototypes.bin"), "size_mb": 340}}
DIM = 512


def models_dir(configured: str | None = None) -> Path:
    return Path(configured) if configured else Path(os.environ.get("XDG_DATA_HOME", Path.home() / ".local" / "share")) / "kinfold" / "models"


def installed(where: Path) -> list[str]:
    return [k for k, m in MODELS.items() if all((where / f).is_file() for f in m["files"])]


def downloadable(where: Path) -> list[str]:
    return [k for k in MODELS if k not in installed(where)]


def find(key: str) -> dict | None:
    return MODELS.get(key)


def remove(where: Path, key: str) -> int:
    """Delete a model's files; how many there were."""
    gone = [where / f for f in MODELS.get(key, {"files": ()})["files"] if (where / f).is_file()]
    for f in gone:
        f.unlink()
    return len(gone)


def prototypes_ok(path: Path, dim: int = DIM) -> bool:
    """The file holds one 32-bit vector a class."""
    return path.is_file() and path.stat().st_size == len(IMAGE_CLASSES) * dim * 4


def load_prototypes(spark, path: Path, dim: int = DIM):
    """idx, label, embedding rows; None without the file, an error for a wrong size."""
    if not path.is_file():
        return None
    if not prototypes_ok(path, dim):
        raise ValueError(f"{path} is not {len(IMAGE_CLASSES)} x {dim} floats")
    x = np.fromfile(path, "<f4").reshape(-1, dim)
    return spark.createDataFrame([(i, IMAGE_CLASSES[i][0], v.tolist()) for i, v in enumerate(x)], "idx int, label string, embedding array<float>")


@dataclass
class Settings:
    """User settings; missing keys of a file take these values, a broken file takes them all."""

    confidence_threshold: float = 0.62
    model_dir: str | None = None
    video_skip_seconds: int = 3
    video_window_seconds: int = 20
    thread_count: int = 4
    cache_size_mb: int = 500

    @classmethod
    def load(cls, path: Path) -> "Settings":
        try:
            raw = json.loads(path.read_text())
            return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})
        except (OSError, ValueError, TypeError):
            return cls()

    def save(self, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(asdict(self), indent=2))
        shutil.move(part, path)
