"""What a caller that works through a file step by step keeps: the table, what was done, and what is proposed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import extract_columns, scan
from .actions import Action, CleaningAction, EngineeringAction, Insight, Worker, next_step
from .api import Confirm, Dataset, carry_out

#: Operations by the name that a request may give, and the worker that each belongs to.
OPERATIONS: dict[str, Worker] = {
    "profile": Worker.CLEANING,
    "numeric": Worker.EDA,
    "categorical": Worker.EDA,
    "chart": Worker.EDA,
    "encode": Worker.FEATURES,
    "bin": Worker.FEATURES,
}


@dataclass
class Session:
    """One file of one user. Nothing in it grows with the data."""

    spark: SparkSession
    file_path: str
    file_format: str
    completed_steps: list[str] = field(default_factory=list)
    insights: list[Insight] = field(default_factory=list)
    pending: Action | None = None

    def __post_init__(self) -> None:
        self._profile: dict | None = None

    @property
    def column_names(self) -> list[str]:
        return extract_columns(self.spark, self.file_path, self.file_format)

    @property
    def data(self) -> Dataset:
        return Dataset(scan(self.spark, self.file_path, self.file_format))

    def worker(self, operation: str) -> Worker:
        """Where a request goes; finished if there is none. ``KeyError`` for operations that are not known."""
        return OPERATIONS[operation] if operation else Worker.FINISH

    def run(self, operation: str, *args, **options) -> DataFrame | tuple[str, DataFrame]:
        """Carry out an operation by name on the file, and note that it was done."""
        self.worker(operation)
        method: Callable = getattr(self.data, operation)
        out = method(*args, **options)
        self.completed_steps.append(operation)
        return out

    def propose(self, proposed: Action | Insight) -> Action | Insight:
        """Keep an insight; or make an action the pending one, a cleaning action with its impact on the profile."""
        if next_step(proposed) == "validator":
            self.insights.append(proposed)
            return proposed
        if isinstance(proposed, CleaningAction):
            if self._profile is None:
                self._profile = self.data.profile_record()
            proposed = proposed.with_impact(self._profile)
        self.pending = proposed
        return proposed

    def apply(self, confirm: Confirm | None = None) -> DataFrame | None:
        """Carry out the pending action, if there is one and ``confirm`` agrees."""
        if not isinstance(self.pending, (CleaningAction, EngineeringAction)):
            return None
        out = carry_out(self.spark, self.pending, confirm)
        if out is not None:
            self.completed_steps.append(self.pending.action.value)
            self.pending = None
        return out
