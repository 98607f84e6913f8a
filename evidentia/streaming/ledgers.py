"""Ledgers as a stream: events are chained as they arrive, a ledger's last digest and number being all the state it has."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia import errors
from evidentia.functions.checks import DISPOSITIONS, STAGES
from evidentia.sources import strict_json
from evidentia.sources.reports import MAX_EVENTS, UTC
from evidentia.workers import ready

EVENT = ["sequence", "action", "item_number", "disposition", "stage", "at"]
CHAINED = T.StructType([T.StructField(c, T.IntegerType() if c in ("sequence", "item_number") else T.StringType()) for c in ("ledger", *EVENT, "previous_event_digest", "digest", "error_code")])
LAST = T.StructType([T.StructField("sequence", T.IntegerType()), T.StructField("digest", T.StringType())])
#: Refusals of an event that does not follow the last, and of one that makes no sense.
CONFLICT, INVALID = errors.CONFLICT[0], errors.LEDGER_INVALID[0]


def coherent(e: dict) -> bool:
    """Fields that fit the action, and a UTC time; how many items the report has is not known here."""
    if e["action"] == "decide":
        fits = e["item_number"] is not None and e["item_number"] >= 1 and e["disposition"] in DISPOSITIONS and e["stage"] is None
    else:
        fits = e["action"] in ("start", "finish") and e["stage"] in STAGES and e["item_number"] is None and e["disposition"] is None
    return bool(fits and e["at"] and UTC.fullmatch(e["at"]))


def plain(v):
    """A value of a frame as JSON has it."""
    return None if v is None or v != v else int(v) if isinstance(v, float) or hasattr(v, "item") else v


class Chain(StatefulProcessor):
    """Append the events of one ledger in order of their numbers; one that is not the next is refused and changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sequence, digest = self.last.get() if self.last.exists() else (0, None)
        out = []
        events = sorted(({c: plain(r[c]) for c in EVENT} for frame in rows for r in frame.to_dict("records")), key=lambda e: (e["sequence"] is None, e["sequence"] or 0, strict_json.canonical(e)))
        for e in events:
            e = dict(e, previous_event_digest=digest)
            error = CONFLICT if e["sequence"] != sequence + 1 else INVALID if sequence >= MAX_EVENTS or not coherent(e) else None
            if error is None:
                sequence, digest = e["sequence"], strict_json.digest(e)
            out.append({"ledger": key[0], **e, "previous_event_digest": None if error else e["previous_event_digest"], "digest": None if error else digest, "error_code": error})
        if sequence:
            self.last.update((sequence, digest))
        made = pd.DataFrame(out, columns=CHAINED.names)
        yield made.astype({"sequence": "Int32", "item_number": "Int32"})

    def close(self) -> None:
        pass


def chained(events: DataFrame) -> DataFrame:
    """A stream of events (ledger, sequence, action, item_number, disposition, stage, at) with their links, or why they are refused.

    ``sequence`` is what the writer expects the event to become: one that another writer took, or that leaves a gap, comes back
    as REVIEW_CONFLICT with no digest, and the writer may send it anew.  Events that do not fit their action are refused
    likewise.  State is one number and one digest a ledger, kept in the stream's checkpoint, so a restart goes on where it
    stopped; a batch that is run again chains the same.
    """
    spark = events.sparkSession
    ready(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.selectExpr("CAST(ledger AS string) AS ledger", *EVENT)
    return keyed.groupBy("ledger").transformWithStateInPandas(statefulProcessor=Chain(), outputStructType=CHAINED, outputMode="Append", timeMode="None")
