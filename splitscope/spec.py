"""Experiment description and decision thresholds, passed to every operator.

Column names are parameters because the two published schemas differ
(``ab_cohort_name``/``open_at``/``publisher_revenue`` versus
``cohort_name``/``created_at``/``revenue``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from splitscope.sources.schemas import SESSION_KEYS


@dataclass(frozen=True)
class Thresholds:
    """Tiered guardrail thresholds (all values in percent or percentage points)."""

    arpu_min_uplift_pct: float = 3.0
    arpu_pvalue: float = 0.10
    significance: float = 0.05
    d1_max_drop_pp: float = 1.0
    avg_session_max_drop_pct: float = 3.0
    med_session_max_drop_pct: float = 4.0
    borderline_pvalue: float = 0.05


@dataclass(frozen=True)
class ExperimentSpec:
    """Names of the columns and cohorts of one experiment."""

    user_col: str = "user_id"
    session_col: str = "session_id"
    cohort_col: str = "ab_cohort_name"
    time_col: str = "open_at"
    platform_col: str = "platform"
    region_col: str = "region"
    segment_col: str = "segment_name"
    revenue_col: str = "publisher_revenue"
    length_col: str = "session_length"
    country_col: str = "country"
    acquired_col: str = "acquired_at"
    # columns that make a session the same session
    session_keys: tuple[str, ...] = SESSION_KEYS
    # measures of a cleaned session and the raw columns whose maximum they are
    session_measures: tuple[tuple[str, str], ...] = (
        ("session_length", "session_length"), ("publisher_revenue", "publisher_revenue"), ("fs_shown", "fs_shown"),
        ("rv_shown", "rv_shown"), ("activity_count", "game_count"), ("offline_activity_count", "offline_game_count"),
    )
    # ads of the two kinds, and the activities, of a cleaned session
    fs_col: str = "fs_shown"
    rv_col: str = "rv_shown"
    activity_col: str = "activity_count"
    control: str = "control"
    # cohorts tested against control in the result tables
    test_cohorts: tuple[str, ...] = ("xxHigh", "xHigh", "gameTune", "xLow", "xxLow")
    # cohorts eligible to win, in tie-break order
    candidates: tuple[str, ...] = ("xxHigh", "xHigh", "gameTune")
    # user-level metric columns
    primary_metric: str = "total_revenue"
    binary_metric: str = "returned_d1"
    continuous_metric: str = "avg_session_length"
    median_metric: str = "median_session_length"
    min_sample: int = 30
    # which segment levels the tests run on
    platforms: tuple[str, ...] | None = ("android", "ios")
    kept_segments: tuple[str, ...] = ("android_new_users", "ios_new_users")
    call_out: str = "gameTune"

    def with_(self, **kw) -> "ExperimentSpec":
        return replace(self, **kw)

    @property
    def all_cohorts(self) -> tuple[str, ...]:
        seen = [self.control]
        for c in self.test_cohorts + self.candidates:
            if c not in seen:
                seen.append(c)
        return tuple(seen)


NOTEBOOK_SPEC = ExperimentSpec()

# The template's schema: cohort_name / created_at / revenue, platforms taken from the data.
TEMPLATE_SPEC = ExperimentSpec(
    cohort_col="cohort_name",
    time_col="created_at",
    revenue_col="revenue",
    platforms=None,
)
