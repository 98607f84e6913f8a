"""Review ledgers: hash-chained decision events, their validation and summary, many ledgers at once.

Events: (ledger, sequence, action, item_number, disposition, stage, at, previous_event_digest, digest).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.checks import DISPOSITIONS, STAGES, utc_timestamp
from evidentia.workers import ready

MAX_EVENTS = 50_000
FIELDS = ["action", "at", "disposition", "item_number", "previous_event_digest", "sequence", "stage"]


def event_json(**columns: Column) -> Column:
    """The canonical JSON of an event without its digest: sorted keys, no blanks, nulls written out."""
    text = {"action", "at", "disposition", "previous_event_digest", "stage"}
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), columns[k], F.lit('"')) if k in text else columns[k].cast("string"), F.lit("null"))) for k in FIELDS if k in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def event_digest() -> Column:
    return F.sha2(event_json(**{k: F.col(k) for k in FIELDS}).cast("binary"), 256)


def coherent(n_items: Column) -> Column:
    """Fields that fit the action, and a UTC time."""
    decide = (F.col("action") == "decide") & F.col("item_number").between(1, n_items) & F.col("disposition").isin(DISPOSITIONS) & F.col("stage").isNull()
    timed = F.col("action").isin("start", "finish") & F.col("stage").isin(STAGES) & F.col("item_number").isNull() & F.col("disposition").isNull()
    return F.coalesce(decide | timed, F.lit(False)) & utc_timestamp(F.col("at"))


def validate(events: DataFrame, n_items: Column | int, max_events: int = MAX_EVENTS) -> DataFrame:
    """(ledger, events, valid): sequence without gaps, coherent fields, chained and recomputed digests, not too many events."""
    n_items = F.lit(n_items) if isinstance(n_items, int) else n_items
    w = Window.partitionBy("ledger").orderBy("sequence")
    ok = (F.col("sequence") == F.row_number().over(w)) & coherent(n_items) & F.col("previous_event_digest").eqNullSafe(F.lag("digest").over(w)) & (F.col("digest") == event_digest())
    return events.withColumn("ok", F.coalesce(ok, F.lit(False))).groupBy("ledger").agg(F.count("*").alias("events"), (F.bool_and("ok") & (F.count("*") <= max_events)).alias("valid"))


def chain(events: DataFrame) -> DataFrame:
    """Events without digests (ledger, sequence, ...) with previous_event_digest and digest, each linked to the one before it.

    Every ledger is folded in order of sequence; a task holds the last digest of one ledger, whatever its length.
    """
    ready(events.sparkSession)
    at = FIELDS.index("previous_event_digest")
    before, after = (event_json(**{k: F.col(k) for k in fields}) for fields in (FIELDS[:at], FIELDS[at + 1 :]))
    rows = events.select(*events.columns, before.alias("before"), after.alias("after"))
    n = len(events.columns)
    place = events.columns.index("ledger")

    def run(batches):
        ledger, last = None, None
        for batch in batches:
            previous, digests = [], []
            for key, head, tail in zip(*(batch.column(i).to_pylist() for i in (place, n, n + 1)), strict=True):
                if key != ledger:
                    ledger, last = key, None
                previous.append(last)
                link = "null" if last is None else f'"{last}"'
                last = hashlib.sha256(f'{head[:-1]},"previous_event_digest":{link},{tail[1:]}'.encode()).hexdigest()
                digests.append(last)
            names = [*batch.schema.names[:n], "previous_event_digest", "digest"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(previous, pa.string()), pa.array(digests, pa.string())], names=names)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in events.dtypes), "previous_event_digest string, digest string"])
    return rows.repartition("ledger").sortWithinPartitions("ledger", "sequence").mapInArrow(run, schema)


def append(events: DataFrame, new: DataFrame) -> DataFrame:
    """Append one event (ledger, action, item_number, disposition, stage, at) to each named ledger, chained to its last."""
    last = events.groupBy("ledger").agg(F.max_by(F.struct("sequence", "digest"), "sequence").alias("last"))
    row = new.join(last, "ledger", "left").withColumns({"sequence": F.coalesce(F.col("last.sequence"), F.lit(0)) + 1, "previous_event_digest": F.col("last.digest")}).drop("last")
    return events.unionByName(row.withColumn("digest", event_digest()).select(*events.columns))


def latest_decisions(events: DataFrame) -> DataFrame:
    return events.where("action = 'decide'").groupBy("ledger", "item_number").agg(F.max_by("disposition", "sequence").alias("disposition"))


def disposition_counts(events: DataFrame) -> DataFrame:
    """Current decisions by disposition, all dispositions listed."""
    n = latest_decisions(events).groupBy("ledger").agg(*(F.count_if(F.col("disposition") == d).alias(d) for d in DISPOSITIONS))
    return events.select("ledger").distinct().join(n, "ledger", "left").select("ledger", *(F.coalesce(d, F.lit(0)).alias(d) for d in DISPOSITIONS))


def unreviewed(events: DataFrame, heads: DataFrame) -> DataFrame:
    """(ledger, unreviewed_count) from heads (ledger, n_items)."""
    seen = events.where("action = 'decide'").groupBy("ledger").agg(F.count_distinct("item_number").alias("seen"))
    return heads.join(seen, "ledger", "left").select("ledger", (F.col("n_items") - F.coalesce("seen", F.lit(0))).alias("unreviewed_count"))


def stage_steps(events: DataFrame) -> DataFrame:
    """Start and finish events with what the stage's state machine makes of them: bad, and the interval a finish closes."""
    t = events.where("action IN ('start', 'finish')").withColumn("us", F.unix_micros(F.to_timestamp("at")))
    w = Window.partitionBy("ledger", "stage").orderBy("sequence")
    prev, prev_us = F.lag("action").over(w), F.lag("us").over(w)
    t = t.withColumns({"prev": prev, "prev_us": prev_us, "is_last": F.lead("action").over(w).isNull()})
    started = F.col("prev") == "start"
    bad = F.when(F.col("action") == "start", started).otherwise(~F.coalesce(started, F.lit(False)) | (F.col("us") < F.col("prev_us")))
    closes = (F.col("action") == "finish") & started & (F.col("us") >= F.col("prev_us"))
    return t.select("ledger", "stage", "sequence", "action", F.coalesce(bad, F.lit(False)).alias("bad"), (F.col("is_last") & (F.col("action") == "start")).alias("open"), F.when(closes, F.col("prev_us")).alias("start_us"), F.when(closes, F.col("us")).alias("end_us"))


def overlapping(steps: DataFrame) -> DataFrame:
    """(ledger, stage) of the stages with an interval that begins before the running longest one ends; both are named."""
    i = steps.where("end_us IS NOT NULL").select("ledger", "stage", "start_us", "end_us")
    w = Window.partitionBy("ledger").orderBy("start_us", "end_us", "stage")
    i = i.withColumn("rn", F.row_number().over(w))
    i = i.withColumn("before", F.max(F.struct(F.col("end_us"), (-F.col("rn")).alias("first"), F.col("stage"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    hit = i.where(F.col("start_us") < F.col("before.end_us"))
    return hit.select("ledger", F.explode(F.array("stage", "before.stage")).alias("stage")).distinct()


def timings(events: DataFrame) -> DataFrame:
    """(ledger, stage, status, seconds): measured only without an open start, a bad step or an overlap, and with an interval."""
    steps = stage_steps(events)
    per = steps.groupBy("ledger", "stage").agg(F.bool_or("bad").alias("bad"), F.bool_or("open").alias("open"), F.count("end_us").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    out = per.join(overlapping(steps).withColumn("over", F.lit(True)), ["ledger", "stage"], "left")
    unknown = F.col("bad") | F.col("open") | F.coalesce("over", F.lit(False)) | (F.col("n") == 0)
    return out.select("ledger", "stage", F.when(unknown, "unknown").otherwise("measured").alias("status"), F.when(~unknown, F.col("us") / 1e6).alias("seconds"))


def summary(events: DataFrame, heads: DataFrame) -> DataFrame:
    """One row a ledger: latest decisions, counts and timing of both stages, also for ledgers without events."""
    decisions = latest_decisions(events).groupBy("ledger").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("item_number").cast("string"), "disposition")))).alias("latest_decisions"))
    counts = disposition_counts(events)
    each = heads.select("ledger", F.explode(F.array(*map(F.lit, STAGES))).alias("stage")).join(timings(events), ["ledger", "stage"], "left")
    timed = each.groupBy("ledger").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.struct("seconds", F.coalesce("status", F.lit("unknown")).alias("status")))))).alias("timing"))
    out = heads.join(unreviewed(events, heads), "ledger").join(decisions, "ledger", "left").join(counts, "ledger", "left").join(timed, "ledger", "left")
    return out.select("ledger", F.coalesce("latest_decisions", F.create_map().cast("map<string,string>")).alias("latest_decisions"), "unreviewed_count", F.create_map(*(x for d in sorted(DISPOSITIONS) for x in (F.lit(d), F.coalesce(d, F.lit(0))))).alias("disposition_counts"), "timing")
