"""Event-impact report for one scope."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from laborloom.operators import impact
from laborloom.periods import EventDates, EventScope, event_dates
from laborloom.schemas import require

# What the event metrics read of schemas.TIMECLOCK.
EVENT_COLUMNS = [
    "location_id",
    "company_id",
    "user_id",
    "event_date",
    "has_clock_in",
    "hours_worked",
    "state",
    "city",
    "msa",
    "employee_count",
    "location_age",
    "loc_archived_at",
]


@dataclass(frozen=True)
class EventReport:
    timeclock: DataFrame
    scope: EventScope
    as_of: date
    literal_years: bool = False
    suppress: bool = False
    check: bool = True

    def __post_init__(self) -> None:
        require(self.timeclock, EVENT_COLUMNS, "timeclock")

    @property
    def dates(self) -> EventDates:
        return event_dates(self.scope, self.as_of)

    def cities(self) -> DataFrame:
        """Spellings of the scope's city; raises when there is none."""
        found = impact.discover_cities(self.timeclock, self.scope.city, self.as_of, self.scope.state)
        return impact.require_city(found, self.scope.city) if self.check else found

    def weekly(self) -> DataFrame:
        return impact.weekly_metrics(self.timeclock, self.scope, self.dates, self.literal_years)

    def deltas(self) -> DataFrame:
        """Year-on-year deltas; raises when the scope has no weeks that two years share.

        The check is one small aggregate over the scope's events; ``check=False`` skips it.
        """
        weekly = self.weekly()
        if self.check:
            impact.require_weeks(weekly, self.scope)
        return impact.yearly_deltas(weekly, self.scope, self.dates, self.suppress)

    def summary(self) -> DataFrame:
        return impact.period_summary(self.deltas())

    def significance(self) -> DataFrame:
        return impact.significance(self.deltas(), self.scope.p_threshold)
