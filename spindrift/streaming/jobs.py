"""A deduplicating job queue as a keyed state machine, over a batch log or a stream.

``Queue.step`` applies an event to the jobs of a project. The batch reducer runs it over an ordered log, the stream keeps the
jobs that are alive as state; both give the same jobs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "cancel_requested", "succeeded", "failed", "cancelled", "superseded")
#: Legal moves between statuses (fixed values).
MOVES = (
    ("pending", "running"),
    ("pending", "cancelled"),
    ("pending", "superseded"),
    ("running", "pending"),
    ("running", "succeeded"),
    ("running", "failed"),
    ("running", "cancel_requested"),
    ("running", "superseded"),
    ("cancel_requested", "cancelled"),
)
_LEGAL = frozenset(MOVES)
ACTIVE = ("running", "cancel_requested")
TERMINAL = ("succeeded", "failed", "cancelled", "superseded")
EVENTS = "project long, seq long, kind string, job long, dedupe string, full_scan boolean, priority int, status string"
JOBS = "project long, job long, dedupe string, full_scan boolean, priority int, status string, superseded_by long"


class Queue:
    """A project's jobs, with those that wait filed by their key and those that are active by their place, so that an event
    touches only the jobs it is about."""

    def __init__(self, jobs: dict[int, dict] | None = None) -> None:
        self.jobs = jobs or {}
        self.waiting: dict[str, int] = {}
        self.active: set[int] = set()
        self.place: dict[int, int] = {}
        self.placed = 0
        self.scan: int | None = None
        for job in self.jobs.values():
            self._enter(job)

    def _enter(self, job: dict) -> None:
        if job["job"] not in self.place:
            self.place[job["job"]] = self.placed
            self.placed += 1
        self._file(job)

    def _file(self, job: dict) -> None:
        alive = job["status"] == "pending" or job["status"] in ACTIVE
        if job["status"] in ACTIVE:
            self.active.add(job["job"])
        else:
            self.active.discard(job["job"])
        if job["full_scan"]:
            self.scan = job["job"] if alive else None if self.scan == job["job"] else self.scan
        elif job["status"] == "pending":
            self.waiting.setdefault(job["dedupe"], job["job"])
        elif self.waiting.get(job["dedupe"]) == job["job"]:
            del self.waiting[job["dedupe"]]

    def _set(self, job: dict, **values) -> None:
        job |= values
        self._file(job)

    def step(self, event: dict) -> None:
        """Apply one event.

        ``submit``: a waiting job of the same key takes the greater priority; a waiting full scan takes up an incremental
        job, which is recorded as superseded; a full scan is idempotent while one waits, runs or is asked to cancel, and
        supersedes waiting incremental jobs. ``move``: legal moves only; late events after a terminal status, and moves to a
        status that another job of the key holds, are dropped. ``recover``: running jobs are superseded by a waiting successor
        of their key or wait again; requested cancellations are done."""
        if event["kind"] == "submit":
            self._submit(event)
        elif event["kind"] == "move":
            job = self.jobs.get(event["job"])
            if job is not None and (job["status"], event["status"]) in _LEGAL:
                if event["status"] != "pending" or job["full_scan"] or job["dedupe"] not in self.waiting:
                    self._set(job, status=event["status"])
        elif event["kind"] == "recover":
            for job in [self.jobs[k] for k in sorted(self.active, key=self.place.__getitem__)]:
                if job["status"] == "cancel_requested":
                    self._set(job, status="cancelled")
                elif not job["full_scan"] and (heir := self.waiting.get(job["dedupe"])) is not None:
                    self._set(job, status="superseded", superseded_by=heir)
                else:
                    self._set(job, status="pending")

    def _submit(self, event: dict) -> None:
        new = {"job": event["job"], "dedupe": event["dedupe"], "full_scan": bool(event["full_scan"]), "priority": event["priority"], "status": "pending", "superseded_by": None}
        if new["full_scan"]:
            if self.scan is not None:
                return
            for job in list(self.waiting.values()):
                self._set(self.jobs[job], status="superseded", superseded_by=new["job"])
        elif (twin := self.waiting.get(new["dedupe"])) is not None:
            self.jobs[twin]["priority"] = max(self.jobs[twin]["priority"], new["priority"])
            return
        elif self.scan is not None and self.jobs[self.scan]["status"] == "pending":
            new |= {"status": "superseded", "superseded_by": self.scan}
        self.jobs[new["job"]] = new
        self._enter(new)

    def sweep(self) -> dict[int, dict]:
        """The jobs that have ended, which no later event can change, taken out of the queue."""
        kept = {*self.waiting.values(), self.scan}
        out = {k: j for k, j in self.jobs.items() if j["status"] in TERMINAL and k not in kept}
        for k in out:
            del self.jobs[k]
        return out


def _frame(project: int, jobs: dict[int, dict]) -> pd.DataFrame:
    names = ("job", "dedupe", "full_scan", "priority", "status", "superseded_by")
    out = pd.DataFrame([[project, *(j[n] for n in names)] for j in jobs.values()], columns=["project", *names])
    return out.astype({"superseded_by": "Int64"})


def _records(pdf: pd.DataFrame, size: int = 8192) -> Iterator[dict]:
    """Rows as dictionaries, by the order of events, so many at a time."""
    pdf = pdf.sort_values("seq")
    for k in range(0, len(pdf), size):
        yield from pdf.iloc[k : k + size].to_dict("records")


def reduce_log(events: DataFrame, sweep: int = 8192) -> DataFrame:
    """The jobs of every project after its whole log; a project's log is reduced by one task.

    Jobs that have ended leave the queue once it has doubled and holds ``sweep`` jobs or more; one that is submitted again later
    counts as it was last."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        project, queue, ended, full = int(pdf["project"].iloc[0]), Queue(), [], sweep
        for event in _records(pdf):
            queue.step(event)
            if len(queue.jobs) >= full:
                ended.append(_frame(project, queue.sweep()))
                full = max(sweep, 2 * len(queue.jobs))
        return pd.concat([*ended, _frame(project, queue.jobs)]).drop_duplicates("job", keep="last")

    return events.groupBy("project").applyInPandas(run, JOBS)


def follow(events: DataFrame) -> DataFrame:
    """The same over a stream: after each batch that holds events of a project, its jobs that are alive and those that ended
    in it (update mode). Jobs that have ended leave the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        queue = Queue({int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {})
        for event in _records(pd.concat(list(batches))):
            queue.step(event)
        state.update((json.dumps({k: j for k, j in queue.jobs.items() if j["status"] not in TERMINAL}, default=int),))
        yield _frame(int(key[0]), queue.jobs)

    return events.groupBy("project").applyInPandasWithState(run, JOBS, "jobs string", "update", "NoTimeout")


def claimable(jobs: DataFrame) -> DataFrame:
    """The pending job each project would run next - greatest priority, then oldest - where none of it is active."""
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("project").distinct()
    waiting = jobs.where("status = 'pending'").join(active, "project", "left_anti")
    return waiting.withColumn("r", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("priority"), "job"))).where("r = 1").drop("r")


def violations(jobs: DataFrame) -> DataFrame:
    """Keys with more than one pending job, or more than one active."""
    n = jobs.groupBy("project", "dedupe").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    return n.where("pending > 1 or active > 1")


def listing(jobs: DataFrame, status: str | None = None, project: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first; the limit is kept between 1 and 200."""
    out = jobs if status is None else jobs.where(F.col("status") == status)
    out = out if project is None else out.where(F.col("project") == project)
    return out.orderBy(F.desc("job")).limit(max(1, min(200, limit)))
