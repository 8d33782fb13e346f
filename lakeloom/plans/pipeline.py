"""Stages over frames, each written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

from lakeloom.frame import Frame
from lakeloom.sources.read import filesystem
from lakeloom.sources.scratch import scratch


class Pipeline:
    """``create(frame).stage(fn)...run()``; a stage is ``Frame -> Frame``.  Intermediate tables go when the run ends."""

    def __init__(self, start: Frame, stages: tuple[Callable[[Frame], Frame], ...] = ()):
        self.start, self.stages = start, stages

    @classmethod
    def create(cls, start: Frame) -> "Pipeline":
        return cls(start)

    def stage(self, fn: Callable[[Frame], Frame]) -> "Pipeline":
        return Pipeline(self.start, (*self.stages, fn))

    def run(self) -> Frame:
        """The last stage's frame, written to a table of its own; the tables before it are deleted."""
        frame, spark, made = self.start, self.start.df.sparkSession, []
        try:
            for i, fn in enumerate(self.stages):
                made.append(f"{scratch(spark)}-stage-{i}")
                frame = fn(frame).materialize_as(made[-1])
            return frame
        finally:
            for path in made[:-1]:
                fs, p = filesystem(spark, path)
                fs.delete(p, True)
