"""Driver-side calendar arithmetic: turns an ``as_of`` date into literals.

Nothing here touches data; the results are passed to operators as literals so
that Catalyst can fold them and prune partitions with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

MONTH_CLOSE_DAY = 27

# The hand-chosen 28-day reference windows, one per year.
PUBLISHED_BENCHMARK_WINDOWS = {
    2018: (date(2018, 1, 4), date(2018, 1, 31)),
    2019: (date(2019, 1, 4), date(2019, 1, 31)),
    2020: (date(2020, 1, 4), date(2020, 1, 31)),
    2021: (date(2021, 1, 9), date(2021, 2, 5)),
    2022: (date(2022, 1, 3), date(2022, 1, 30)),
    2023: (date(2023, 1, 8), date(2023, 2, 4)),
    2024: (date(2024, 1, 7), date(2024, 2, 3)),
    2025: (date(2025, 1, 5), date(2025, 2, 1)),
    2026: (date(2026, 1, 4), date(2026, 1, 31)),
}


def check_windows(windows: dict[int, tuple[date, date]]) -> dict[int, tuple[date, date]]:
    """Every window must span exactly four of each weekday (28 days)."""
    for year, (first, last) in windows.items():
        days = (last - first).days + 1
        if days != 28:
            raise ValueError(f"benchmark window of {year} spans {days} days, expected 28")
    ordered = sorted(windows.values())
    for (_, last), (first, _) in zip(ordered, ordered[1:]):
        if first <= last:
            raise ValueError("benchmark windows overlap")
    return windows


def sunday_window(year: int) -> tuple[date, date]:
    """28 days from the first Sunday on or after January 4."""
    first = date(year, 1, 4)
    first += timedelta(days=(6 - first.weekday()) % 7)
    return first, first + timedelta(days=27)


def week_floor(day: date, first: str = "sunday") -> date:
    back = (day.weekday() + 1) % 7 if first == "sunday" else day.weekday()
    return day - timedelta(days=back)


def shift_years(day: date, years: int) -> date:
    """Same calendar day in another year; February 29 falls back to 28."""
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)


@dataclass(frozen=True)
class ReportAnchor:
    """Closing date of the report and the two payroll cohort months."""

    report_end: date

    @property
    def cohort_start(self) -> tuple[int, int]:
        return self.report_end.year - 1, self.report_end.month

    @property
    def cohort_end(self) -> tuple[int, int]:
        return self.report_end.year, self.report_end.month


def report_anchor(as_of: date) -> ReportAnchor:
    """The 27th of this month once it has passed, else of the month before."""
    close = as_of.replace(day=MONTH_CLOSE_DAY)
    if as_of.day <= MONTH_CLOSE_DAY:
        close = (as_of.replace(day=1) - timedelta(days=1)).replace(day=MONTH_CLOSE_DAY)
    return ReportAnchor(close)


def month_close(day: date) -> date:
    """The reporting month (28th to 27th) a day belongs to, named by its last day."""
    if day.day <= MONTH_CLOSE_DAY:
        return day.replace(day=MONTH_CLOSE_DAY)
    return (day.replace(day=28) + timedelta(days=7)).replace(day=MONTH_CLOSE_DAY)


def month_open(close: date) -> date:
    """First day of the reporting month that closes on ``close``."""
    return (close.replace(day=1) - timedelta(days=1)).replace(day=MONTH_CLOSE_DAY) + timedelta(days=1)


def month_bounds(year: int, month: int) -> tuple[date, date]:
    """First day of a calendar month and first day of the next one."""
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


@dataclass(frozen=True)
class EventScope:
    """What an event-impact run looks at."""

    event_start: date | None
    event_end: date | None
    city: str | None = None
    state: str | None = None
    msa: str | None = None
    pre_weeks: int = 4
    post_weeks: int = 6
    prior_years: int = 2
    min_locations: int = 30
    p_threshold: float = 0.05


@dataclass(frozen=True)
class EventDates:
    """Dates derived from a scope and ``as_of``.

    ``safe_end`` leaves out the running week and the one before it, whose
    records are still arriving. The pre-event stretch is anchored to
    ``safe_end``, not to the event.
    """

    safe_end: date
    pre_start: date
    post_end: date | None
    data_start: date
    data_end: date
    has_during: bool
    has_post: bool


def event_dates(scope: EventScope, as_of: date) -> EventDates:
    safe_end = week_floor(as_of, "monday") - timedelta(days=8)
    pre_start = safe_end - timedelta(weeks=scope.pre_weeks) + timedelta(days=1)
    post_end = scope.event_end + timedelta(weeks=scope.post_weeks) if scope.event_end else None
    return EventDates(
        safe_end=safe_end,
        pre_start=pre_start,
        post_end=post_end,
        data_start=shift_years(pre_start, -scope.prior_years),
        data_end=min(post_end, safe_end) if post_end else safe_end,
        has_during=scope.event_start is not None and safe_end >= scope.event_start,
        has_post=scope.event_end is not None and safe_end > scope.event_end,
    )
