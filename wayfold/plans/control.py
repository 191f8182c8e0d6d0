"""Budgets of a run: stages, solves, counters.  Time is a function that is passed in, so tests and replays are exact."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class StageClock:
    """Deadlines of stages under one global deadline, and what each took."""

    limit_s: float
    now: Callable[[], float] = time.monotonic
    timings: dict[str, int] = field(default_factory=dict)
    exhausted: list[str] = field(default_factory=list)
    records: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.began = self.now()
        self.stage, self.stage_began, self.deadline = None, self.began, self.began + self.limit_s

    def begin(self, stage: str, budget_s: float) -> None:
        self.stage, self.stage_began = stage, self.now()
        self.deadline = min(self.stage_began + budget_s, self.began + self.limit_s)

    def remaining(self) -> float:
        return max(0.0, self.began + self.limit_s - self.now())

    def stage_remaining(self) -> float:
        return max(0.0, self.deadline - self.now())

    def over(self) -> bool:
        """Whether the global limit is reached."""
        return self.remaining() <= 0

    def expired(self) -> bool:
        if self.now() < self.deadline:
            return False
        if self.stage and self.stage not in self.exhausted:
            self.exhausted.append(self.stage)
        return True

    def end(self, reason: str = "done") -> None:
        took = round((self.now() - self.stage_began) * 1000)
        self.timings[self.stage] = self.timings.get(self.stage, 0) + took
        self.records.append({"stage": self.stage, "elapsed_ms": took, "stop_reason": reason})
        self.stage, self.deadline = None, self.began + self.limit_s

    def diagnostics(self) -> dict:
        return {"limit_s": self.limit_s, "elapsed_ms": round((self.now() - self.began) * 1000), "stages": list(self.records), "exhausted": list(self.exhausted)}


@dataclass
class Ledger:
    """How many solves a run may attempt, asked before each; what became of them."""

    budget: int
    limit_s: float
    least_start_s: float = 0.0
    now: Callable[[], float] = time.monotonic
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("planned", "attempted", "succeeded", "failed", "timed_out", "reused", "skipped"), 0))
    stopped: str | None = None

    def __post_init__(self):
        self.deadline = self.now() + self.limit_s

    def plan(self, n: int = 1) -> None:
        self.counts["planned"] += n

    def left(self) -> int:
        return max(0, self.budget - self.counts["attempted"])

    def may_start(self) -> bool:
        return self.stopped is None and self.left() > 0 and self.deadline - self.now() >= self.least_start_s

    def attempt(self) -> None:
        self.counts["attempted"] += 1

    def record(self, what: str) -> None:
        if what not in self.counts:
            raise ValueError(what)
        self.counts[what] += 1
        if what == "timed_out":
            self.counts["failed"] += 1

    def stop(self, why: str) -> None:
        self.stopped = self.stopped or why

    def diagnostics(self) -> dict:
        return self.counts | {"left": self.left(), "stopped": self.stopped}


def within_budget(solves: DataFrame, most: int, order: list) -> DataFrame:
    """The solves of each instance that its budget admits, first come first served."""
    n = F.row_number().over(Window.partitionBy("instance_id").orderBy(*order))
    return solves.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def ledger_counts(solves: DataFrame, most: int, order: list) -> DataFrame:
    """planned, attempted, succeeded, failed, timed_out and skipped per instance of solves (column outcome)."""
    n = F.row_number().over(Window.partitionBy("instance_id").orderBy(*order))
    t = solves.withColumn("tried", n <= most)
    got = lambda o: F.count_if(F.col("tried") & (F.col("outcome") == o))
    return t.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("tried").alias("attempted"), got("ok").alias("succeeded"), (got("error") + got("timeout")).alias("failed"), got("timeout").alias("timed_out"), F.count_if(~F.col("tried")).alias("skipped")
    )
