"""Progress of running requests: the last thirty, with percentages that never fall."""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

MOST_JOBS = 30


@dataclass
class Job:
    number: str
    mode: str
    status: str = "running"
    stage: str = "queued"
    percentage: float | None = None
    error: str | None = None


class Jobs:
    def __init__(self, most: int = MOST_JOBS):
        self.most, self._jobs, self._lock = most, OrderedDict(), threading.Lock()

    def start(self, mode: str) -> str:
        with self._lock:
            number = uuid.uuid4().hex
            self._jobs[number] = Job(number, mode)
            while len(self._jobs) > self.most:
                self._jobs.popitem(last=False)
            return number

    def get(self, number: str) -> Job | None:
        return self._jobs.get(number)

    def update(self, number: str, stage: str | None = None, percentage: float | None = None) -> None:
        with self._lock:
            if job := self._jobs.get(number):
                job.stage = stage or job.stage
                if percentage is not None:
                    job.percentage = max(job.percentage or 0.0, min(100.0, max(0.0, float(percentage))))

    def finish(self, number: str, error: str | None = None) -> None:
        with self._lock:
            if job := self._jobs.get(number):
                job.status, job.stage, job.error = ("failed", "failed", error) if error else ("success", "completed", None)
                if not error:
                    job.percentage = 100.0

    @contextmanager
    def running(self, spark: SparkSession, mode: str):
        """Spark's jobs inside carry the job's number as their group; a failure is noted and goes on."""
        number = self.start(mode)
        spark.sparkContext.setJobGroup(number, mode)
        try:
            yield number
        except Exception as e:
            self.finish(number, str(e)[:500] or type(e).__name__)
            raise
        self.finish(number)

    def follow(self, spark: SparkSession, number: str) -> float | None:
        """The percentage of tasks that are done of those that Spark knows of."""
        tracker, done, all_tasks = spark.sparkContext.statusTracker(), 0, 0
        for j in tracker.getJobIdsForGroup(number):
            for s in (tracker.getJobInfo(j) or type("none", (), {"stageIds": []})).stageIds:
                if info := tracker.getStageInfo(s):
                    done, all_tasks = done + info.numCompletedTasks, all_tasks + info.numTasks
        if all_tasks:
            self.update(number, percentage=min(99.0, 100 * done / all_tasks))
        job = self.get(number)
        return job.percentage if job else None
