"""Monthly report: the labor, wages and jobs series plus the overview."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborloom import schemas
from laborloom.operators import roster, wages
from laborloom.operators.benchmark import month_benchmark, weekday_benchmark
from laborloom.operators.index import daily_actuals, labor_index
from laborloom.operators.overview import overview
from laborloom.operators.quality import suppress_small
from laborloom.operators.reuse import shared
from laborloom.periods import ReportAnchor, month_close, report_anchor
from laborloom.schemas import require


@dataclass(frozen=True)
class MonthlyInputs:
    """Tables of the monthly track. ``benchmarks`` is the stored reference
    table; leave it out to derive it from events."""

    events: DataFrame
    payroll_runs: DataFrame
    locations: DataFrame
    companies: DataFrame
    jobs: DataFrame
    job_versions: DataFrame
    benchmarks: DataFrame | None = None

    def __post_init__(self) -> None:
        require(self.events, schemas.SHIFT_EVENTS, "shift events")
        require(self.payroll_runs, schemas.PAYROLL_RUNS, "payroll runs")
        require(self.locations, schemas.LOCATIONS, "locations")
        require(self.companies, schemas.COMPANIES, "companies")
        require(self.jobs, schemas.JOBS, "jobs")
        require(self.job_versions, schemas.JOB_VERSIONS, "job versions")
        if self.benchmarks is not None:
            require(self.benchmarks, schemas.BENCHMARKS, "benchmarks")


@dataclass(frozen=True)
class MonthlyReport:
    """One report run; every method returns a lazy DataFrame.

    Inside ``reuse.shared_frames`` the methods stage what several of them need (daily series, job pay, roster series) once
    for the whole report.
    """

    tables: MonthlyInputs
    as_of: date
    labor_start: date
    wage_start: date
    roster_start: date
    base_month: tuple[int, int] = (2022, 1)
    turnover_horizon: date | None = roster.TURNOVER_HORIZON

    @property
    def anchor(self) -> ReportAnchor:
        return report_anchor(self.as_of)

    def labor(
        self,
        windows: dict[int, tuple[date, date]] | None = None,
        benchmark: str = "table",
        by: Sequence[str] = (),
        min_locations: int | None = None,
    ) -> DataFrame:
        """Indexed employees, hours and open businesses.

        ``benchmark`` is "table" (stored, or built over ``windows``) or "month"
        (derived from January's actuals). ``min_locations`` drops groups with
        fewer contributing locations.
        """
        events = self.tables.events
        if benchmark == "month":
            # Only January's days are read for the levels, only anchor weeks for the index.
            january = events.filter(F.month("event_date") == 1)
            levels = month_benchmark(daily_actuals(january, self.labor_start, self.as_of))
        elif benchmark == "table":
            levels = self.tables.benchmarks
            if levels is None:
                levels = weekday_benchmark(events, windows)
        else:
            raise ValueError(f"benchmark is 'table' or 'month', not {benchmark!r}")
        return shared(labor_index(events, levels, self.labor_start, self.as_of, by, min_locations=min_locations), "labor")

    def wages(self, segments: dict[str, str] = wages.SEGMENTS) -> DataFrame:
        """National and segment wage rates with percent above the base month."""
        cohort = wages.payroll_cohort(self.tables.payroll_runs, self.anchor)
        labelled = wages.with_segments(cohort, self.tables.locations, segments)
        cuts = wages.wage_cuts(wages.labelled_pay(self._pay(), labelled))
        return wages.against_base(cuts, *self.base_month, by=["segmented_by", "segment"])

    def _pay(self) -> DataFrame:
        """Pay of the cohort by job and month, which the national and the segment rates share."""
        cohort = wages.payroll_cohort(self.tables.payroll_runs, self.anchor)
        return shared(wages.job_pay(self.tables.events, cohort, self.wage_start, self.anchor.report_end), "job-pay")

    def national_wages(self) -> DataFrame:
        return wages.against_base(wages.wage_rates(self._pay()), *self.base_month)

    def _roster_scope(self) -> tuple[DataFrame, date, date]:
        info = roster.location_info(self.tables.companies, self.tables.locations, self.as_of)
        return shared(info, "location-info"), month_close(self.roster_start), self.anchor.report_end

    def hiring(self, min_locations: int | None = None) -> DataFrame:
        series = roster.hiring(self.tables.jobs, *self._roster_scope())
        return roster.per_location(_thinned(shared(series, "hiring"), min_locations))

    def turnover(self, dedupe: bool = False, min_locations: int | None = None) -> DataFrame:
        info, first, last = self._roster_scope()
        series = roster.turnover(
            self.tables.jobs, self.tables.job_versions, info, first, last, dedupe, self.turnover_horizon
        )
        return roster.per_location(_thinned(shared(series, "turnover"), min_locations))

    def overview(self, windows: dict[int, tuple[date, date]] | None = None) -> DataFrame:
        return overview(self.labor(windows), self.national_wages(), self.hiring(), self.turnover())


def _thinned(series: DataFrame, min_locations: int | None) -> DataFrame:
    """Months of a roster series with enough locations (``ss``)."""
    return series if min_locations is None else suppress_small(series, "ss", min_locations)
