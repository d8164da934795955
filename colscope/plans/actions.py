"""What is proposed to be done to a column, as records; checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from ..functions.types import cast_type
from ..operators.binning import Binning
from ..operators.clean import Cleaning
from ..operators.encode import Encoding
from ..operators.impact import impact

RISKS = ("low", "medium", "high")


class Worker(str, Enum):
    """The parts of the library that a request may go to."""

    CLEANING = "cleaning"
    EDA = "eda"
    FEATURES = "feature_engineering"
    FINISH = "FINISH"


@dataclass(frozen=True)
class Action:
    """Where the data is and goes to, why, and what is known of the effect."""

    file_path: str
    file_format: str
    output_path: str
    reason: str
    column: str
    rows_affected: int | None = None
    rows_affected_pct: float | None = None
    risk_level: str | None = None

    def __post_init__(self) -> None:
        if self.risk_level not in (None, *RISKS):
            raise ValueError(f"risk_level is one of {', '.join(RISKS)}")


@dataclass(frozen=True)
class CleaningAction(Action):
    action: Cleaning | str = Cleaning.DROP_ROWS
    target_dtype: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "action", Cleaning(self.action))
        if self.action is Cleaning.CAST_DTYPE:
            if not self.target_dtype:
                raise ValueError("cast_dtype needs target_dtype")
            cast_type(self.target_dtype)

    def with_impact(self, profile: dict) -> CleaningAction:
        rows, share = impact(profile, self.column, self.action)
        return replace(self, rows_affected=rows, rows_affected_pct=share)


@dataclass(frozen=True)
class EngineeringAction(Action):
    action: Encoding | Binning | str = Encoding.LABEL
    n_bin: int = 10
    order_key: str | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        kinds = {k.value: k for k in (*Encoding, *Binning)} | {f"{k.value}_encoding": k for k in Encoding}
        if self.action not in kinds:
            raise ValueError(f"unknown action {self.action!r}")
        object.__setattr__(self, "action", kinds[self.action])
        if self.n_bin < 1:
            raise ValueError("n_bin is 1 at least")


@dataclass(frozen=True)
class Insight:
    """A finding of the exploration."""

    metric_name: str
    value: float
    n_rows: int
    chart_path: str | None = None
    confidence_note: str | None = None


def next_step(proposed: Action | Insight) -> str:
    """Insights go to validation, actions to the calculation of their impact."""
    return "validator" if isinstance(proposed, Insight) else "compute_impact"
