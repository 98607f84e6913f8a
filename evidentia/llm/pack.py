"""Sum-of-squares packing of documents into token sequences of one size.

Tasks encode whole texts and cut documents that are longer than a sequence; a piece shorter than a sequence is an item.  Items of
one length are alike, so the packing is settled on the number of items of each length, of which there are fewer than the
sequence has tokens however large the corpus is: lengths fall, and each block of a length's items goes to the open bins whose
residual gap makes the sum of the squared numbers of open bins per gap smallest; an empty bin is opened where no open bin has
room.  The plan maps the n-th item of a length to a bin and an offset.  An item's number is its number among its task's items of
that length plus those of the tasks before, a running sum over one row a task and length, so no task ever sees all items and the
waste does not depend on how the table is partitioned.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.bpe import Bpe, PairTable, bpe_of, chunks, load_spec, rows
from evidentia.llm.common import stored

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 2048, 0
#: Items of one length are placed in so many blocks at least (an item each, where there are fewer).
BLOCKS = 16
#: Characters of text that are encoded at once, at least.
CHARS = 4_000_000


class PackedEncoder:
    """Whole texts to ids, many at a time: each different word is merged once, then all words take their ids."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.pairs = bpe, PairTable(bpe)

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text and the one that ends it."""
        cut, special = self.bpe.cut, self.bpe.special
        flat: list[str] = []
        odd: dict[int, int] = {}  # special strings and ends by their places
        ends: list[int] = []
        for t in texts:
            if cut and cut.search(t):
                for i, p in enumerate(cut.split(t)):
                    if i % 2:
                        odd[len(flat)] = special[p]
                        flat.append("")
                    else:
                        flat += self.bpe.words(p)
            else:
                flat += self.bpe.words(t)
            odd[len(flat)] = end
            ends.append(len(flat))
            flat.append("")
        coded = pa.array(flat, pa.string()).dictionary_encode()
        ids, first, many = self.pairs.ids_of(coded.dictionary)
        word = coded.indices.to_numpy()
        first, many = first[word], many[word]
        at = np.fromiter(odd, dtype=np.int64, count=len(odd))
        ids, first[at], many[at] = np.append(ids, np.fromiter(odd.values(), dtype=np.int32, count=len(odd))), len(ids) + np.arange(len(odd)), 1
        stop = np.cumsum(many)
        every = ids[np.repeat(first - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)].astype("<u4")
        return np.split(every, stop[ends][:-1]) if texts else []


def cut_pieces(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, after a shorter first piece where one is left over."""
    first = length % size or min(length, size)
    return [(0, first)] + [(at, size) for at in range(first, length, size)]


def encoded_pieces(docs: DataFrame, vocabulary: str, size: int, end: int, id_column: str, text: str, with_ids: bool) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, ids on request, and its task and its number among the task's of its length."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_spec(vocabulary))

    def run(batches):
        encoder, task = PackedEncoder(bpe_of(spec.value)), TaskContext.get().partitionId()
        met = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in chunks((r for part in rows(batch) for r in part), CHARS):
                out: list[list] = [[], [], [], [], [], [], []]
                for (key, _), whole in zip(part, encoder.encode([t or "" for _, t in part], end), strict=True):
                    for piece, (start, length) in enumerate(cut_pieces(len(whole), size)):
                        ids = whole[start : start + length]
                        values = (key, piece, start, length, zlib.crc32(ids), int(met[length]), ids.astype(np.int32) if with_ids else None)
                        met[length] += 1
                        for column, v in zip(out, values, strict=True):
                            column.append(v)
                n = len(out[0])
                kinds = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["id", "piece", "start", "length", "ids_crc32", "nth", "ids"]
                arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)][: 7 if with_ids else 6]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(n, task, dtype=np.int64))], names=[*names[: len(arrays)], "task"])

    schema = f"id {dict(docs.dtypes)[id_column]}, piece int, start long, length long, ids_crc32 long, nth long" + (", ids array<int>" if with_ids else "") + ", task long"
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Bins:
    """Open bins of each residual gap, as runs of consecutive bin numbers."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def take(self, gap: int, n: int) -> list[tuple[int, int]]:
        """n bins of a gap, as runs (first, how many)."""
        held, out = self.runs[gap], []
        while n:
            first, many = held.pop()
            if many > n:
                held.append((first + n, many - n))
                many = n
            out.append((first, many))
            n -= many
        return out

    def put(self, gap: int, runs: list[tuple[int, int]]) -> None:
        held = self.runs[gap]
        for first, many in reversed(runs):
            if held and held[-1][0] == first + many:
                held[-1] = (first, held[-1][1] + many)
            else:
                held.append((first, many))


def sum_of_squares(counts: dict[int, int], size: int = SIZE, blocks: int = BLOCKS) -> np.ndarray:
    """The plan, rows of (length, number of the first item, items, first bin, offset), for counts of items by length below the size.

    Falling lengths; a block of k items of length s moves k bins from gap g to gap g - s, which changes the sum of squares by
    k * (2 * (n[g - s] - n[g]) + 2 * k), with n the numbers of open bins, and by k * (k - 2 * n[g]) where it fills them; the gap
    of the least change an item is taken, the narrowest of equals.  An empty bin is opened where no open bin has room, so that
    none is begun in vain.
    """
    n, bins, plan, opened = np.zeros(size + 1, dtype=np.int64), Bins(), [], 0
    for s in sorted((s for s in counts if 0 < s < size and counts[s]), reverse=True):
        left, item = int(counts[s]), 0
        block = -(-left // blocks)
        while left:
            k = min(block, left)
            room = np.flatnonzero(n[s:size])  # of gaps s, s + 1, ...
            if len(room):
                moved = np.minimum(k, n[s + room])
                change = np.where(room == 0, moved - 2 * n[s], 2 * (n[room] - n[s + room] + moved))
                gap, k = s + int(room[change.argmin()]), int(moved[change.argmin()])
                taken, offset = bins.take(gap, k), size - gap
                n[gap] -= k
            else:
                gap, taken, offset, opened = size, [(opened, k)], 0, opened + k
            if gap > s:
                n[gap - s] += k
                bins.put(gap - s, taken)
            for first, many in taken:
                plan.append((s, item, many, first, offset))
                item += many
            left -= k
    return np.asarray(plan, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack the tokens of all documents, each ended by ``end``, into sequences of at most ``size`` tokens.

    Returns a row a piece: (id, piece int from 0, start, length, ids_crc32, sequence_id, offset) and, with ``with_ids``, ``ids``;
    the pieces of a sequence stand at offsets 0 to its length without gaps.  Only documents longer than a sequence are cut, each
    into whole sequences after a first piece that may be shorter.  A null or empty text is the end id alone.  Repeated rows, and
    rows without an id, are packed each for itself.  Other columns are left out, so their names cannot clash; an empty table gives
    an empty table.  Whole sequences have negative ids, shared ones count from 0.

    The driver holds one number for each length below ``size`` and the plan, a few numbers for each of at most ``BLOCKS`` blocks a
    length; encoded pieces are stored once, so a lost executor costs its tasks alone.
    """
    spark = docs.sparkSession
    pieces = stored(encoded_pieces(docs, vocabulary, size, end, id_column, text, with_ids))
    met = pieces.where(F.col("length") < size).groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in met.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(sum_of_squares(counts, size))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = met.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["length", "task"], "left")
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        plan = shared.value
        order = np.lexsort((plan[:, 1], plan[:, 0]))
        length, item, _, first, offset = plan[order].T
        from_key = length * (1 << 50) + item
        for batch in batches:
            whole = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth", "task")}
            nth = whole["nth"] + np.nan_to_num(batch.column("base").to_numpy(zero_copy_only=False)).astype(np.int64)
            sequence, place = -1 - (whole["task"] * (1 << 33) + whole["nth"]), np.zeros(batch.num_rows, dtype=np.int64)
            part = np.flatnonzero(whole["length"] < size)
            at = np.searchsorted(from_key, whole["length"][part] * (1 << 50) + nth[part], side="right") - 1
            sequence[part], place[part] = first[at] + nth[part] - item[at], offset[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "offset"])

    schema = f"id {dict(docs.dtypes)[id_column]}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    columns = [*names, "nth", "task", F.coalesce("base", F.lit(0)).alias("base")]
    return numbered.select(*columns).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def sequences(packed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(sequence_id, ids array<int>, pieces array<struct<offset, length, id, piece>>) of what ``pack`` gave with ids.

    A sequence has at most ``size`` tokens, so a group is bounded.  An empty table gives an empty table.
    """
    piece = F.struct("offset", "length", F.col(id_column).alias("id"), "piece", "ids")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("held"))
    ids = F.flatten(F.transform("held", lambda x: x["ids"]))
    told = F.transform("held", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["id"].alias("id"), x["piece"].alias("piece")))
    return grouped.select("sequence_id", ids.alias("ids"), told.alias("pieces"))
