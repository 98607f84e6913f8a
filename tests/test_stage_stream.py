"""Stage timings of a stream against those of all its events at once."""

import random
from collections import Counter

from evidentia.operators import ledger
from evidentia.streaming import stages

SCHEMA = "ledger string, sequence int, action string, stage string, at string, arrived timestamp"


def stamp(second):
    return f"2024-01-01T{second // 3600:02}:{second // 60 % 60:02}:{second % 60:02}Z"


def steps_of(rng, name):
    """Mostly starts and ends in turn, with overlaps, repeated starts and stages without an end."""
    second, out = rng.randrange(100), []
    for _ in range(rng.randrange(1, 9)):
        stage = rng.choice(["triage", "evidence", "decision"])
        for action in rng.choice([("start", "finish")] * 6 + [("start",), ("finish",)]):
            out.append((name, len(out) + 1, action, stage, stamp(second)))
            second += rng.randrange(0, 60)
    return out


def test_measures_are_those_of_all_events(spark):
    rng = random.Random(2)
    books = {f"l{i}": steps_of(rng, f"l{i}") for i in range(200)}
    frame = spark.createDataFrame([e for v in books.values() for e in v], "ledger string, sequence int, action string, stage string, at string")
    want = {(r["ledger"], r["stage"]): (r["status"], None if r["seconds"] is None else round(r["seconds"] * 1e6)) for r in ledger.timings(frame).collect()}
    seconds = lambda at: (int(at[11:13]) * 3600 + int(at[14:16]) * 60 + int(at[17:19])) * 1_000_000
    got = {(k, s): m for k, v in books.items() for s, m in stages.measures([(n, a, s, seconds(at)) for _, n, a, s, at in v]).items()}
    assert got == want and {m[0] for m in got.values()} == {"measured", "unknown"}


def test_out_of_order_events_are_measured_and_late_ones_named(spark, tmp_path):
    rng = random.Random(5)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    books = {f"l{i}": steps_of(rng, f"l{i}") for i in range(12)}
    late = {("l0", 900, "start", "triage", stamp(0)), ("l1", 901, "finish", "decision", stamp(1))}
    batches = [[], [], []]
    for events in books.values():
        for i, e in enumerate(events):
            batches[min(2, 3 * i // len(events) + rng.randrange(2))].append(e)
    for key in ("l0", "l1"):  # so that these ledgers have a late time before the last batch
        batches[0].append((key, 500, "start", "evidence", stamp(80_000)))
        books[key] = [*books[key], (key, 500, "start", "evidence", stamp(80_000))]
        batches[0] += [e for b in batches[1:] for e in b if e[0] == key]
        batches[1:] = [[e for e in b if e[0] != key] for b in batches[1:]]
    batches[2] += [*late, batches[0][0]]  # one comes a second time
    batches.append([("z", 1, "start", "triage", stamp(5))])  # long after: the others have been silent

    seen = Counter()

    def run(number, rows):
        arrived = [(*e, f"2024-02-01 {number * 2:02}:{rng.randrange(60):02}:00") for e in rows]
        spark.createDataFrame(arrived, SCHEMA.replace("timestamp", "string")).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        told = stages.stage_times(stream, "arrived", delay_seconds=3600, patience_seconds=3600)
        told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination()
        every = Counter(tuple(r) for r in spark.read.parquet(str(out)).collect())
        new = every - seen
        seen.update(new)
        return [(number, *r) for r in new.elements()]

    rows = [r for number, batch in enumerate(batches) for r in run(number, batch)]
    assert sorted((r[1], r[4]) for r in rows if r[2] == "late") == [("l0", 900), ("l1", 901)]
    frame = spark.createDataFrame([e for v in books.values() for e in v], "ledger string, sequence int, action string, stage string, at string")
    want = {(r["ledger"], r["stage"]): (r["status"], None if r["seconds"] is None else round(r["seconds"] * 1e6)) for r in ledger.timings(frame).collect()}
    last = {}
    for number, name, kind, stage, _, us in rows:
        if kind in ("measured", "unknown") and name != "z":
            last[name, stage] = (kind, us)
    assert last == want
    opened = {(r[1], r[3]) for r in rows if r[2] == "open"}
    steps = ledger.stage_steps(frame).where("open").select("ledger", "stage").collect()
    assert opened >= {(r["ledger"], r["stage"]) for r in steps} and ("l0", "evidence") in opened
