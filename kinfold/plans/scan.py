"""The scan from files to stored groups, as one plan a category. Files are listed without their content; only those that the signature cache does not know are opened."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.paths import parse_categories
from kinfold.operators import report
from kinfold.plans.detectors import Detector, defaults, dice_groups, groups_of, table_detector, video_hash_similarity
from kinfold.sources import files as files_source
from kinfold.sources.store import SessionStore
from kinfold.streaming import incremental


@dataclass(frozen=True)
class ScanConfig:
    categories: tuple[str, ...] = ("image", "document", "video", "archive", "code")
    threshold: float = 0.95
    recursive: bool = True
    min_size: int = files_source.SCAN_MIN_BYTES
    max_size: int | None = None
    similarity: str = "exact"  # documents and code: "exact" on normalised text, or "dice" on its bigrams
    name: str = "scan"
    detectors: dict[str, Detector] = field(default_factory=defaults)

    def __post_init__(self):
        if self.similarity not in ("exact", "dice"):
            raise ValueError(f"unknown similarity {self.similarity!r}; known: exact, dice")


@dataclass(frozen=True)
class Summary:
    """What a scan saw: files found, left out and unreadable, signatures from the cache and new, groups and files in them."""

    session: int
    found: int
    skipped: int
    skipped_permission: int
    cached: int
    computed: int
    groups: int
    files: int

    def lines(self) -> list[str]:
        return [f"Found {self.found} files, skipped {self.skipped} ({self.skipped_permission} without permission)", f"Signatures: {self.cached} from the cache, {self.computed} new", f"{self.groups} groups of duplicates with {self.files} files"]


def scan(spark: SparkSession, roots: list[str], store: SessionStore, cfg: ScanConfig = ScanConfig(), session: int | None = None, video_signatures: DataFrame | None = None) -> int:
    """Scan the roots into a new session, or append to ``session``; the session's id. ``video_signatures`` (path, signature) come from an outside frame hasher."""
    return scan_summary(spark, roots, store, cfg, session, video_signatures).session


def scan_summary(spark: SparkSession, roots: list[str], store: SessionStore, cfg: ScanConfig = ScanConfig(), session: int | None = None, video_signatures: DataFrame | None = None) -> Summary:
    """``scan``, and what it saw."""
    kinds = parse_categories(list(cfg.categories))
    detectors = {k: d for k, d in cfg.detectors.items() if k in kinds}
    if video_signatures is not None and "video" in kinds:
        detectors["video"] = table_detector("video", video_signatures, video_hash_similarity)
    session = session or store.create_session(cfg.name, kinds, cfg.threshold)
    store.update_status(session, "running")
    # written: a listing is not taken again for each reader of it, and sees one state of the folders
    listing = store.scratch(files_source.listed(spark, roots, cfg.recursive, kinds, cfg.min_size, cfg.max_size), "listing")
    status = {r.status: r.n for r in report.status_counts(listing).collect()}
    found = listing.filter("status = 'found'").drop("status")
    signed, hits = incremental.signed(found, store, detectors, (spark, roots))
    members = groups_of(signed.select("path", "category", "signature"), {k: d for k, d in detectors.items() if not (cfg.similarity == "dice" and d.normal)}, cfg.threshold)
    if cfg.similarity == "dice":
        for d in detectors.values():
            if d.normal:
                members = members.unionByName(dice_groups(found.filter(F.col("category") == d.category), d, cfg.threshold))
    members = store.scratch(members.join(signed.select("path", "size", "modified"), "path"), "members")
    store.add_groups(session, members)
    store.update_status(session, "completed")
    n = members.agg(F.count("*").alias("files"), F.count_distinct("category", "group_path").alias("groups")).first()
    left_out = sum(n for s, n in status.items() if s not in ("found", "unselected", "no_extension"))
    return Summary(session, status.get("found", 0), left_out, status.get("skipped_permission", 0), hits["cached"], hits["computed"], n.groups, n.files)
