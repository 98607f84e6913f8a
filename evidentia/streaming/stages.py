"""Stage timings of ledgers in event time: out-of-order events within a delay are measured exactly, later ones are named."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.workers import ready


def _fields(text: str, longs: str, integers: str = "") -> T.StructType:
    kinds = {c: T.LongType() for c in longs.split()} | {c: T.IntegerType() for c in integers.split()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in text.split()])


#: kind: measured or unknown (a stage as its ledger has it now), late (an event that counts no more), open (a stage without end).
TOLD = _fields("ledger kind stage sequence us", "us", "sequence")
STEP = _fields("sequence action stage us", "us", "sequence")
LATEST, STATUS, STAGE = _fields("us", "us"), _fields("status us", "us"), _fields("stage", "")


def measures(steps: list[tuple[int, str, str, int]]) -> dict[str, tuple[str, int | None]]:
    """(status, microseconds) by stage of (sequence, action, stage, time) steps, as ``ledger.timings`` has them."""
    last: dict[str, tuple[str, int]] = {}
    unknown: set[str] = set()
    intervals: list[tuple[int, int, str]] = []
    for _, action, stage, us in sorted(steps):
        before = last.get(stage)
        started = before is not None and before[0] == "start"
        if action == "start":
            if started:
                unknown.add(stage)
        elif not started or us < before[1]:
            unknown.add(stage)
        else:
            intervals.append((before[1], us, stage))
        last[stage] = (action, us)
    unknown |= {s for s, (action, _) in last.items() if action == "start"}
    longest: tuple[int, str] | None = None
    for start, end, stage in sorted(intervals):
        if longest and start < longest[0]:
            unknown |= {stage, longest[1]}
        if longest is None or end > longest[0]:
            longest = (end, stage)
    spent: dict[str, int] = {}
    for start, end, stage in intervals:
        spent[stage] = spent.get(stage, 0) + end - start
    return {s: ("unknown", None) if s in unknown or s not in spent else ("measured", spent[s]) for s in last}


class Stages(StatefulProcessor):
    """One ledger's steps; its measures are told whenever they change, its open stages when nothing more is heard of it."""

    def __init__(self, delay_us: int, patience_ms: int):
        self.delay, self.patience = delay_us, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", STEP)
        self.latest = handle.getValueState("latest", LATEST)
        self.told = handle.getMapState("told", STAGE, STATUS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        steps = [tuple(s) for s in self.steps.get()] if self.steps.exists() else []
        known, out, new, heard = {s[0] for s in steps}, [], [], 0
        for frame in rows:
            for e in frame.to_dict("records"):
                heard = max(heard, int(e["arrived_ms"]))
                step = (int(e["sequence"]), e["action"], e["stage"], int(e["us"]))
                if step[0] in known:  # an event that comes twice counts once
                    continue
                if latest is not None and step[3] < latest - self.delay:
                    out.append((key[0], "late", step[2], step[0], step[3]))
                else:
                    known.add(step[0])
                    new.append(step)
        if new:
            self.steps.appendList(new)
            self.latest.update((max(s[3] for s in new) if latest is None else max(latest, *(s[3] for s in new)),))
            for stage, now in sorted(measures(steps + new).items()):
                before = tuple(self.told.getValue((stage,))) if self.told.containsKey((stage,)) else None
                if before != now:
                    self.told.updateValue((stage,), now)
                    out.append((key[0], now[0], stage, None, now[1]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if heard:
            self.handle.registerTimer(heard + self.patience)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Stages whose last step is a start, once the ledger has been silent for the patience."""
        last: dict[str, tuple] = {}
        for s in sorted(tuple(s) for s in self.steps.get()) if self.steps.exists() else []:
            last[s[2]] = s
        yield self.frame([(key[0], "open", stage, s[0], s[3]) for stage, s in sorted(last.items()) if s[1] == "start"])

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=TOLD.names).astype({"sequence": "Int32", "us": "Int64"})

    def close(self) -> None:
        pass


def stage_times(events: DataFrame, arrived: str, delay_seconds: float, patience_seconds: float, arrival_slack: str = "1 minute") -> DataFrame:
    """A stream of events (ledger, sequence, action, stage, at, and a column of their arrival) with what they tell of stages.

    Rows are (ledger, kind, stage, sequence, us): ``measured`` with the microseconds of a stage, or ``unknown``, whenever that
    changes, so the last row of a stage is what ``ledger.timings`` gives for all events that were not late; ``late`` for an event
    whose time lies more than the delay before the latest that its ledger had in earlier batches, which changes nothing; ``open``
    for each stage without an end when the arrivals of the whole stream have gone on for the patience without an event of
    that ledger.  Lateness is judged by a ledger's own events, so a slow ledger is not late against a fast one; the watermark
    runs on arrivals and drives the timers alone.  A ledger's events are bounded, and so is its state.
    """
    spark = events.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    steps = events.where("action IN ('start', 'finish')").withWatermark(arrived, arrival_slack)
    keyed = steps.select(F.col("ledger").cast("string").alias("ledger"), "sequence", "action", "stage", F.unix_micros(F.to_timestamp("at")).alias("us"), arrived, F.unix_millis(arrived).alias("arrived_ms"))
    processor = Stages(round(delay_seconds * 1e6), round(patience_seconds * 1e3))
    return keyed.groupBy("ledger").transformWithStateInPandas(statefulProcessor=processor, outputStructType=TOLD, outputMode="Append", timeMode="EventTime")
