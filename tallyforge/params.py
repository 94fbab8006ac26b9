"""Parameters of scoring, matching and browsing."""

from __future__ import annotations

from dataclasses import dataclass, field

VERSION = "v1"


@dataclass(frozen=True)
class ScoringParams:
    version: str = VERSION
    least_per_source: int = 3
    least_to_calibrate: int = 10
    least_to_trim: int = 20
    trim_share: float = 0.05
    disclosure: float = 0.95
    top_genres: int = 40
    top_platforms: int = 25


@dataclass(frozen=True)
class CustomScoreConfig:
    """The two multipliers scale every weight, so they cancel in the mean; they are kept for parity."""

    language: str | None = None
    platform: str | None = None
    exclude_outliers: bool = False
    reduce_big_media: bool = False
    boost_indie: bool = False
    disabled_sources: frozenset = field(default_factory=frozenset)


@dataclass(frozen=True)
class BackfillOptions:
    """What a backfill from a provider fetches and writes; nothing is written unless ``write`` is set.

    At most one of ``target_samples`` and ``missing_only`` may be given: they are different ways to choose items.
    """

    provider: str = "web"
    years: tuple[int, ...] = ()
    most_pages: int = 50
    most_items: int | None = None
    most_review_pages: int | None = None
    most_existing: int = 10
    least_listed: int = 5
    target_samples: frozenset[int] = frozenset()
    missing_only: bool = False
    purge: bool = False
    list_only: bool = False
    write: bool = False

    def __post_init__(self):
        if self.target_samples and self.missing_only:
            raise ValueError("target_samples and missing_only exclude one another")
        if self.purge and self.missing_only:
            raise ValueError("a purge would make every item a missing one")


@dataclass(frozen=True)
class RepairOptions:
    """Which items a repair takes; ``metadata`` repairs titles and years alone. Nothing is written without ``write``."""

    archive: str = "archive"
    web: str = "web"
    rival: str = "rival"
    sample_counts: frozenset[int] = frozenset({50, 100})
    only_without_rival: bool = False
    skip_existing_web: bool = False
    limit: int | None = None
    least_listed: int = 0
    year_tolerance: int = 1
    metadata: bool = False
    least_score: float = 0.0
    least_sample: int = 0
    require_rival: bool = False
    skip_existing_identity: bool = False
    list_only: bool = False
    write: bool = False


@dataclass(frozen=True)
class RunOptions:
    """The whole run: whether tables are made anew, which optional steps take part, and the parameters of the steps."""

    rebuild: bool = False
    publish: bool = True
    mock: bool = False
    include: frozenset[str] = frozenset()
    scoring: ScoringParams = field(default_factory=ScoringParams)
    backfill: BackfillOptions = field(default_factory=BackfillOptions)
    repair: RepairOptions = field(default_factory=RepairOptions)
