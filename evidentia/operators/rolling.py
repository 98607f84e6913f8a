"""Dictionaries beyond a worker's memory: places of a text that may begin a title, by rolling hashes.

A title is known by the hash of its leading characters, the most of ``LEADS`` that it has.  The hashes of all windows of a text
come from one running sum, so the work grows with the length of the text alone.  A bitmap of the titles' hashes, as large at
any number of titles, lets few windows through; only these are joined with the titles.  The least lead is looked up at every
place, longer ones where it passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.workers import ready

#: Leading characters by which titles are known.
LEADS = (16, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
#: Bits of the bitmap that every task holds, as a power of two, and of one piece of it as Spark builds it.
BITMAP, PIECE = 26, 32_768
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of some texts, set one behind the other."""

    powers = np.ones((2, 1), dtype=np.uint64)  # of the base and its inverse

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        coded = b"".join(t.encode("utf-32-le", "surrogatepass") for t in texts)
        chars = mixed(np.frombuffer(coded, dtype="<u4").astype(np.uint64) + np.uint64(1))
        n = len(chars)
        if self.powers.shape[1] < n + 1:
            grow = max(n + 1, 1 << 16)
            Windows.powers = np.stack([np.cumprod(np.r_[np.uint64(1), np.full(grow, b, dtype=np.uint64)], dtype=np.uint64) for b in (BASE, INVERSE)])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * self.powers[0, :n], dtype=np.uint64)])
        self.text = np.repeat(np.arange(len(texts)), self.size)
        self.begin = (np.cumsum(self.size) - self.size)[self.text]
        self.left = (np.cumsum(self.size))[self.text] - np.arange(n)

    def hashes(self, lead: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places that have ``lead`` characters before their text's end, hashes of the windows there), of all places or ``among`` some."""
        if among is None:
            n = max(len(self.left) - lead + 1, 0)
            fits = self.left[:n] >= lead
            at, raw = np.flatnonzero(fits), ((self.sums[lead : lead + n] - self.sums[:n]) * self.powers[1, :n])[fits]
        else:
            at = among[self.left[among] >= lead]
            raw = (self.sums[at + lead] - self.sums[at]) * self.powers[1, at]
        return at, mixed(raw + np.uint64(lead)).view(np.int64)


def keyed(titles: DataFrame) -> DataFrame:
    """(title, lead, gram, short) of the distinct non-empty titles; ``short`` is the hash of as many leading characters as all of them have."""
    titles = titles.select("title").where("title <> ''")
    shortest = titles.agg(F.min(F.length("title"))).first()[0] or 1
    common = next(n for n in LEADS if shortest >= n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lead = np.array([next(n for n in LEADS if len(t) >= n) for t in texts], dtype=np.int32)
            gram = np.zeros(len(texts), dtype=np.int64)
            for n in np.unique(lead).tolist():
                mine = np.flatnonzero(lead == n)
                gram[mine] = Windows([texts[i][:n] for i in mine.tolist()]).hashes(n)[1]
            short = Windows([t[:common] for t in texts]).hashes(common)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lead), pa.array(gram), pa.array(short)], names=["title", "lead", "gram", "short"])

    ready(titles.sparkSession)
    return titles.distinct().mapInArrow(run, "title string, lead int, gram long, short long")


def bitmap(wanted: DataFrame) -> tuple[bytes, list[int]]:
    """(bits of all grams and short hashes, their leads): built in pieces on the cluster, 2 ** BITMAP bits at most on the driver."""
    bit = F.shiftrightunsigned("hash", 64 - BITMAP)
    pieces = wanted.select("lead", F.explode(F.array("gram", "short")).alias("hash")).groupBy(F.floor(bit / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg((bit % PIECE).cast("long")).alias("bits"), F.collect_set("lead").alias("leads"))
    bits, leads = bytearray((1 << BITMAP) // 8), set()
    for r in pieces.collect():
        at = r["piece"] * PIECE // 8
        bits[at : at + len(r["bits"])] = r["bits"]
        leads |= set(r["leads"])
    return bytes(bits), sorted(leads)


def meetings(nodes: DataFrame, titles: DataFrame, key: list[str]) -> DataFrame:
    """(key, met array<struct<start, title>>): places of nodes whose window has the hash of a title's lead; to be verified."""
    spark = nodes.sparkSession
    wanted = keyed(titles)
    bits, leads = bitmap(wanted)
    shared = spark.sparkContext.broadcast(bits)
    key_schema = [nodes.schema[c] for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, dtype=np.uint8)

        def passing(at, gram):
            bit = gram.view(np.uint64) >> np.uint64(64 - BITMAP)
            hit = (known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return at[hit], gram[hit]

        for batch in batches:
            windows = Windows([t or "" for t in batch.column("text").to_pylist()])
            # a title begins only where the characters stand that the least lead, which all titles have, takes of it
            first = passing(*windows.hashes(leads[0])) if leads else None
            for lead in leads:
                at, gram = first if lead == leads[0] else passing(*windows.hashes(lead, first[0]))
                rows = pa.array(windows.text[at])
                start = (at - windows.begin[at]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in key), pa.array(start), pa.array(gram)], names=[*key, "start", "gram"])

    schema = T.StructType([*key_schema, T.StructField("start", T.IntegerType()), T.StructField("gram", T.LongType())])
    places = nodes.select(*key, "text").mapInArrow(run, schema)
    return places.join(wanted.select("gram", "title"), "gram").groupBy(*key).agg(F.collect_list(F.struct("start", "title")).alias("met"))
