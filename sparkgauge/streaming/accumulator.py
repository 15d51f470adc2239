"""The accumulator of a live run: typed state and timers for each run, a progress row for every status event.

Constraints are steps `(state, row) -> action`, registered by name in `plugins.STEPS`; the state is that after the row, the action is
"continue" or "stop".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import ENDED, PROGRESS
from ..plugins import STEPS

STATE = "begin_us long, last_us long, created long, completed long, errored long, cancelled long, in_flight long, area long, latency_us long, output_tokens long, stopped_by string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunAccumulator(StatefulProcessor):
    """Counts, concurrency over time, sums of finished requests, phase and stop of one run."""

    def __init__(self, warmup_us: int, active_us: int | None, steps: list[tuple[str, Callable[[dict, Any], str]]]):
        self.warmup_us, self.active_us, self.steps = warmup_us, active_us, steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", STATE)

    def phase(self, begin: int | None, now: int) -> str:
        if begin is None:
            return "pending"
        since = now - begin
        if since < self.warmup_us:
            return "warmup"
        return "cooldown" if self.active_us is not None and since >= self.active_us else "active"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE.split(", ")]
        s = dict(zip(names, self.run.get() if self.run.exists() else (None, None, 0, 0, 0, 0, 0, 0, 0, 0, None), strict=True))
        batch = pd.concat(list(rows))
        batch = batch.assign(_start=(batch["status"] == "in_progress").astype(int)).sort_values(["t_us", "_start", "request_id"], kind="stable")
        out = []
        for row in batch.itertuples(index=False):
            if row.status == "in_progress" and s["begin_us"] is None:
                s["begin_us"] = int(row.t_us)
                for after in (self.warmup_us, self.active_us):
                    if after:
                        self.handle.registerTimer(-(-(s["begin_us"] + after) // 1000))
            if s["last_us"] is not None:
                s["area"] += s["in_flight"] * max(0, int(row.t_us) - s["last_us"])
            s["last_us"] = max(int(row.t_us), s["last_us"] if s["last_us"] is not None else int(row.t_us))
            if row.status == "in_progress":
                s["created"] += 1
                s["in_flight"] += 1
            elif row.status in ENDED:
                s["in_flight"] -= bool(row.started)
                # What was cancelled before it began counts nowhere.
                if row.status != "cancelled" or row.started:
                    s[row.status] += 1
                    s["latency_us"] += int(row.latency_us)
                    s["output_tokens"] += int(row.output_tokens)
            for name, step in self.steps:
                if s["stopped_by"] is None and step(s, row) == "stop":
                    s["stopped_by"] = name
            out.append((key[0], row.request_id, row.status, row.t_us, self.phase(s["begin_us"], int(row.t_us)), *(s[c] for c in ("in_flight", "completed", "errored", "cancelled", "area", "latency_us", "output_tokens", "stopped_by"))))
        self.run.update(tuple(s.values()))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PROGRESS.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """A row of its own where a phase begins; it has no request and no counts, as these belong to events."""
        begin = self.run.get()[0]
        ms = expiredTimerInfo.getExpiryTimeInMs()
        at = next(begin + after for after in (self.warmup_us, self.active_us) if after and -(-(begin + after) // 1000) == ms)
        yield pd.DataFrame({f.split()[0]: pd.Series([None], dtype=object) for f in PROGRESS.split(", ")}).assign(run_index=key[0], status="phase", t_us=at, phase=self.phase(begin, at))

    def close(self) -> None:
        pass


def live_progress(events: DataFrame, warmup_us: int = 0, active_us: int | None = None, constraints: dict[str, dict] | None = None, late: str = "0 seconds") -> DataFrame:
    """A progress row (`lifecycle.PROGRESS`) for every status event of a stream, and one where a run's warm-up or active phase ends.

    events: run_index, request_id, t_us, status (in_progress, completed, errored, cancelled; others move only the clock),
    started (whether a request that ended had begun), latency_us and output_tokens of those that ended. Events of a batch are taken
    in order of time, ends before starts; those later than the watermark are dropped. constraints: options of steps by name.
    """
    spark = events.sparkSession
    if spark.conf.get(STORE, None) != ROCKS:
        spark.conf.set(STORE, ROCKS)  # the only store that has typed state and timers
    steps = [(name, STEPS.find(name)(**options)) for name, options in (constraints or {}).items()]
    timed = events.where("t_us is not null").withColumn("at", F.timestamp_micros("t_us")).withWatermark("at", late)
    return timed.groupBy("run_index").transformWithStateInPandas(RunAccumulator(warmup_us, active_us, steps), PROGRESS, "append", "EventTime")
