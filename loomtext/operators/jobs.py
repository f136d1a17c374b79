"""Work handed to an outside service as one job: submit, wait, fetch, and check that every slot was answered."""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class JobError(RuntimeError):
    """A job that was stopped, or answers that don't fit their slots."""


class JobService(Protocol):
    """``submit`` takes rows (slot, prompt) and gives the job's name; ``fetch`` gives rows (slot, answer, problem), problem null for good ones."""

    def submit(self, requests: DataFrame) -> str: ...

    def state(self, job: str) -> str: ...

    def fetch(self, job: str) -> DataFrame: ...


class StubService:
    """Answers each prompt with itself in capitals; the states it goes through are given."""

    def __init__(self, states: tuple[str, ...] = ("running", "ended")):
        self.states, self.jobs = list(states), {}

    def submit(self, requests: DataFrame) -> str:
        name = f"job{len(self.jobs)}"
        self.jobs[name] = requests
        return name

    def state(self, job: str) -> str:
        return self.states.pop(0) if len(self.states) > 1 else self.states[0]

    def fetch(self, job: str) -> DataFrame:
        return self.jobs[job].select("slot", F.upper("prompt").alias("answer"), F.lit(None).cast("string").alias("problem"))


def waited(service: JobService, job: str, pause: float = 30.0, longest: float = 86_400.0) -> None:
    """Return once the job has ended; a job that was stopped, or lasts longer than ``longest`` seconds, is an error."""
    began = time.monotonic()
    while (state := service.state(job)) != "ended":
        if state in ("canceling", "canceled"):
            raise JobError(f"{job} was stopped")
        if time.monotonic() - began >= longest:
            raise JobError(f"{job} is still {state}")
        time.sleep(pause)


def slot_faults(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Slots whose answers don't fit: ``slot`` and ``fault`` (missing, unknown, repeated, failed). None: every slot has one good answer."""
    asked = requests.groupBy("slot").agg(F.count("*").alias("asked"))
    got = answers.groupBy("slot").agg(F.count("*").alias("got"), F.count("problem").alias("failed"))
    both = asked.join(got, "slot", "full").fillna(0, ["asked", "got", "failed"])
    fault = F.when(F.col("got") == 0, "missing").when(F.col("asked") == 0, "unknown").when((F.col("got") > 1) | (F.col("asked") > 1), "repeated").when(F.col("failed") > 0, "failed")
    return both.select("slot", fault.alias("fault")).where("fault is not null")


def fetched(service: JobService, job: str, requests: DataFrame) -> DataFrame:
    """``slot`` and ``answer`` of a job that has ended; nothing is returned unless every slot has one good answer."""
    if (state := service.state(job)) != "ended":
        raise JobError(f"{job} is still {state}")
    answers = service.fetch(job)
    bad = slot_faults(requests, answers)
    shown = bad.orderBy("slot").limit(5).collect()  # a few for the message
    if shown:
        raise JobError(f"{job}: " + ", ".join(f"{r['slot']} {r['fault']}" for r in shown))
    return answers.select("slot", "answer")


def run(service: JobService, requests: DataFrame, pause: float = 30.0, longest: float = 86_400.0) -> DataFrame:
    """Submit ``requests`` (slot, prompt), wait for the job and return its checked answers."""
    job = service.submit(requests)
    waited(service, job, pause, longest)
    return fetched(service, job, requests)
