"""Queries that run on while their progress is asked for, and that can be called off."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Polled:
    """An action in a thread and a job group of its own.

    state is running, done, failed or cancelled; result holds what the action
    gave, error what it raised.
    """

    def __init__(self, spark: SparkSession, action: Callable[[], object], title: str = "") -> None:
        self.context, self.action, self.title = spark.sparkContext, action, title
        self.group, self.state, self.result, self.error = uuid.uuid4().hex, "running", None, None
        self._off = False
        self.thread = InheritableThread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        self.context.setJobGroup(self.group, self.title, interruptOnCancel=True)
        try:
            self.result = self.action()
            self.state = "done"
        except Exception as e:  # noqa: BLE001 - a poll tells of it
            self.error, self.state = e, "cancelled" if self._off else "failed"

    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks known of, over all stages so far that are still on record."""
        tracker = self.context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
        stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def cancel(self) -> None:
        """Calls off the jobs that run now; the action ends with the error that they give."""
        self._off = True
        self.context.cancelJobGroup(self.group)

    def wait(self, seconds: float | None = None) -> str:
        self.thread.join(seconds)
        return self.state
