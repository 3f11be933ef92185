"""User-defined stages: named functions DataFrame -> DataFrame, run in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """The extension point: any step that maps a frame to a frame; works on batches and streams alike."""

    steps: list[tuple[str, Step]] = field(default_factory=list)

    @classmethod
    def of(cls, steps: Sequence[Step]) -> Pipeline:
        return cls([(getattr(s, "__name__", f"step{i}"), s) for i, s in enumerate(steps)])

    def add(self, name: str, step: Step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = df.transform(step)
        return df
