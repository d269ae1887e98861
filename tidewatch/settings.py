"""Tunable parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Settings:
    """Window widths, split days and the choice of feature semantics.

    ``use_velocity`` derives travel speed from consecutive events of an entity.
    ``low_slow`` is ``"cumulative"`` (count since the frame began) or
    ``"trailing"`` (last seven days).  ``breadth`` is ``"window"`` (new
    resources within the last hour) or ``"first_seen"`` (this event's resource
    is new).  ``footprint`` is ``"first_week"`` or ``"none"`` (always 0).
    ``watermark`` is how late a row of a stream may come.
    """

    train_days: int = 30
    rolling_days: int = 14
    cold_start_events: int = 5
    fail_window: int = 5 * MINUTE
    ip_window: int = 5 * MINUTE
    breadth_window: int = HOUR
    low_slow_days: int = 7
    use_velocity: bool = True
    low_slow: str = "cumulative"
    breadth: str = "window"
    footprint: str = "first_week"
    watermark: str = "1 hour"

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


# The features as a plain batch run of the original rules yields them: no travel
# speed, first-seen flags and no footprint growth.
PLAIN_BATCH = Settings(use_velocity=False, breadth="first_seen", footprint="none")
