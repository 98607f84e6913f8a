"""Ledgers as a stream, stopped and started again, against the chain of all events at once."""

import random

from evidentia.operators import ledger
from evidentia.streaming import ledgers

SCHEMA = "ledger string, sequence int, action string, item_number int, disposition string, stage string, at string"


def event(rng, name, n):
    if rng.random() < 0.5:
        return (name, n, "decide", rng.randrange(1, 9), rng.choice(["confirm", "defer"]), None, f"2024-01-01T00:00:{n % 60:02}Z")
    return (name, n, rng.choice(["start", "finish"]), None, None, rng.choice(["triage", "decision"]), f"2024-01-01T00:00:{n % 60:02}.5Z")


def test_a_restarted_stream_equals_one_chain(spark, tmp_path):
    rng = random.Random(3)
    books = {f"l{i}": [event(rng, f"l{i}", n) for n in range(1, rng.randrange(2, 25))] for i in range(9)}
    todo = {k: list(v) for k, v in books.items()}
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        query = ledgers.chained(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination()

    refused = []
    for part in range(3):
        rows = []
        for k, left in todo.items():
            n = len(left) if part == 2 else rng.randrange(0, 9)
            rows += left[:n]
            del left[:n]
        rng.shuffle(rows)  # a batch may bring a ledger's events in any order
        if part == 1:
            stale = next(v[0] for k, v in books.items() if v[0] not in rows and len(v) > len(todo[k]))
            bad = [stale, ("l0", 900, *stale[2:]), ("new", 1, "decide", None, "confirm", None, stale[-1]), ("new", 1, "start", None, None, "triage", "yesterday")]
            rows += bad
            refused = [(b[0], b[1], c) for b, c in zip(bad, ["REVIEW_CONFLICT"] * 2 + ["REVIEW_LEDGER_INVALID"] * 2)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(source))
        run()  # each run is a new query on the state of the last

    got = spark.read.parquet(str(out)).collect()
    assert sorted((r["ledger"], r["sequence"], r["error_code"]) for r in got if r["error_code"]) == sorted(refused)
    assert all(r["digest"] is None and r["previous_event_digest"] is None for r in got if r["error_code"])
    want = ledger.chain(spark.createDataFrame([e for v in books.values() for e in v], SCHEMA)).collect()
    key = lambda r: (r["ledger"], r["sequence"], r["item_number"], r["previous_event_digest"], r["digest"])
    assert sorted(map(key, (r for r in got if not r["error_code"])), key=str) == sorted(map(key, want), key=str)
    whole = ledger.validate(spark.read.parquet(str(out)).where("error_code IS NULL"), 9).collect()
    assert len(whole) == len(books) and all(r["valid"] for r in whole)
