"""Job parameters. Defaults are the fixed values of the domain; every one can be overridden."""

from __future__ import annotations

from dataclasses import dataclass, field

EARTH_RADIUS_M = 6_371_000.0


@dataclass(frozen=True)
class HotGroups:
    """When a group counts as hot, and the size of the pieces it is cut into.

    A group above ``max_rows`` is never handed to one task: it is split into pieces of
    ``chunk_rows`` rows that run in parallel. At most ``total_rows / max_rows`` groups can
    be hot, which is what bounds the broadcast of their keys.
    """

    max_rows: int = 2_000_000
    chunk_rows: int = 250_000


@dataclass(frozen=True)
class DriftConfig:
    """Cardiac-drift analysis: 61-row trailing frame, one sample per 5 s, crisis above 5 %."""

    n_prev: int = 60
    sample_period_s: float = 5.0
    crisis_pct: float = 5.0
    drift_decimals: int = 9
    hot: HotGroups = field(default_factory=HotGroups)


@dataclass(frozen=True)
class DetectorConfig:
    """Stillness alarm: moved at most 10 m for 30 index units with a heart rate above 180.

    ``buckets`` is the number of groups that live sessions are dealt into, some for every core of the cluster. A task holds
    the events and the state of its state partition's buckets that a micro-batch touches, see :func:`paceframe.streaming.jobs.for_backlog`.
    """

    move_m: float = 10.0
    still_index: int = 30
    alarm_bpm: float = 180.0
    seconds_per_index: float = 1.0
    sample_period_s: float = 5.0
    idle_timeout: str = "2 hours"
    buckets: int = 128
    hot: HotGroups = field(default_factory=HotGroups)


@dataclass(frozen=True)
class TrainingConfig:
    """Training index: athlete days longer than 500 m, averaged over the last 42 days."""

    min_distance_m: float = 500.0
    window_days: int = 42


@dataclass(frozen=True)
class LoadConfig:
    """Load ratio (definition ours): 7-day sum against the 28-day daily mean times 7."""

    acute_days: int = 7
    chronic_days: int = 28
    caution_ratio: float = 1.3
    danger_ratio: float = 1.5
