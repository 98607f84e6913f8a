"""Periodic runs of words by a suffix tree, after Stoye and Gusfield.

A run that counts repeats its period four times, so each of its four-word sequences stands at least twice in the text: maximal
stretches of such places, found by counts of hashes, hold every run whole, and only they enter the tree.  The stretches of many
texts make one forest: suffixes sorted by doubling, common prefixes of neighbours by the same ranks, inner nodes as intervals of
equal prefixes.  Each leaf climbs from one light edge to the next, so it is in the smaller half of the leaf lists that it is
tested in; a leaf i below a node of depth q with leaf i + q or i - q below the same node but not the same child is a branching
tandem repeat.  Repeats rotate to the left as far as words q apart agree, which merges those of one run, and of the periods of
one stretch the smallest is its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.workers import ready

#: A run has at least so many words, and so many times its period.
WORDS, TIMES = 6, 4
#: Words of texts that are searched at once, at least, and bits of the table that counts hashes of four words.
AT_ONCE, BITS = 200_000, 22

Run = tuple[int, int, int]


def repeated_places(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the four words from each place on may stand elsewhere in its text, too (false for the last three of a text)."""
    out = np.zeros(len(word), dtype=bool)
    if len(word) < 4:
        return out
    h = text[:-3].astype(np.uint64) + np.uint64(1)
    for i in range(4):
        h = (h ^ word[i : len(word) - 3 + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
    inside = text[:-3] == text[3:]
    out[:-3] = inside & (np.bincount(slot[inside], minlength=1 << BITS)[slot] > 1)
    return out


def stretches(word: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the places that hold the runs: three or more successive repeated places and the three words after them."""
    edge = np.diff(np.concatenate([[0], repeated_places(word, text).astype(np.int8), [0]]))
    return [(a, b + 3) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b + 3 - a >= WORDS]


def doubled_ranks(word: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: the order of the 2**k words from i on, until all differ; beyond the end stand words that are before all others.

    Every word sequence must end in a word of its own.
    """
    n = len(word)
    ranks = [np.unique(word, return_inverse=True)[1].astype(np.int64)]
    while ranks[-1].max() < n - 1:
        step, last = 1 << (len(ranks) - 1), ranks[-1]
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = last[step:] + 1
        ranks.append(np.unique(last * (n + 1) + after, return_inverse=True)[1])
    return ranks


def common_prefixes(ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """lcp[i]: words that the suffixes order[i - 1] and order[i] share from their beginnings; 0 for the first."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = ranks[k][a[same]] == ranks[k][b[same]]
        out[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


class Tree:
    """Inner nodes of a suffix tree: depth, parent, and the first and last suffix in order that are below each.

    Node 0 is the root.  ``above`` is the node right above each leaf, ``head`` of a node the nearest one at or above it that is not
    the largest child of its parent.
    """

    def __init__(self, lcp: np.ndarray):
        depth, first, last, parent, above = [0], [0], [len(lcp) - 1], [-1], [0] * len(lcp)
        open_nodes = [0]
        for i, shared in enumerate([*lcp[1:].tolist(), 0]):  # what leaf i shares with the next one
            begin, closed = i, -1
            while depth[open_nodes[-1]] > shared:
                closed = open_nodes.pop()
                last[closed], begin = i, first[closed]
                if depth[open_nodes[-1]] >= shared:
                    parent[closed] = open_nodes[-1]
                    closed = -1
            if depth[open_nodes[-1]] < shared:
                if closed >= 0:
                    parent[closed] = len(depth)
                open_nodes.append(len(depth))
                depth.append(shared)
                first.append(begin)
                last.append(-1)
                parent.append(-1)
            for leaf in (i, i + 1):
                if leaf < len(above) and depth[above[leaf]] < shared:
                    above[leaf] = open_nodes[-1]
        self.depth, self.first, self.last, self.parent, self.above = (np.asarray(x, dtype=np.int64) for x in (depth, first, last, parent, above))
        size = self.last - self.first
        by_parent = np.lexsort((size, self.parent))
        largest = by_parent[np.append(np.diff(self.parent[by_parent]) != 0, True)]
        self.head = np.arange(len(size))
        largest = largest[self.parent[largest] >= 0]
        self.head[largest] = self.parent[largest]
        while (jumped := self.head[self.head]).tolist() != self.head.tolist():
            self.head = jumped


def branching_repeats(word: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares whose first word after them differs from the one a period before."""
    n, rank = len(word), ranks[-1]
    order = np.argsort(rank)
    tree = Tree(common_prefixes(ranks, order))
    node = tree.above[rank]
    leaf, starts, periods = np.arange(n), [], []
    while True:
        live = tree.depth[node] > 0
        leaf, node = leaf[live], node[live]
        if not len(leaf):
            break
        depth, first, last = tree.depth[node], tree.first[node], tree.last[node]
        for start, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
            there = (other >= 0) & (other < n)
            at = rank[np.where(there, other, 0)]
            there &= (at >= first) & (at <= last)
            begin, q = start[there], depth[there]
            fork = word[begin + q] != word[begin + 2 * q]
            starts.append(begin[fork])
            periods.append(q[fork])
        node = tree.parent[tree.head[node]]
        up = node >= 0
        leaf, node = leaf[up], node[up]
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.concatenate(periods) * (n + 1) + np.concatenate(starts))
    return found % (n + 1), found // (n + 1)


def agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words from a[i] on and those from b[i] on are the same for length[i] words."""
    out = (a >= 0) & (b >= 0)
    k = np.zeros(len(a), dtype=np.int64)
    while (more := (2 << k) <= length).any():
        k[more] += 1
    for level in np.unique(k[out & (length > 0)]).tolist():  # two overlapping powers of two cover a length
        i = np.flatnonzero(out & (k == level) & (length > 0))
        r, back = ranks[min(level, len(ranks) - 1)], length[i] - (1 << level)
        out[i] = (r[a[i]] == r[b[i]]) & (r[a[i] + back] == r[b[i] + back])
    return out


def rotated(word: np.ndarray, start: int, period: int) -> int:
    """Where the stretch of this period that holds the square at ``start`` begins."""
    step = 64
    while start > 0:
        low = max(0, start - step)
        differ = np.flatnonzero(word[low:start] != word[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 4 * step
    return start


def forest_runs(word: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of words, where each stretch ends in a word of its own."""
    ranks = doubled_ranks(word)
    start, period = branching_repeats(word, ranks)
    need = np.maximum(WORDS, TIMES * period) - 2 * period  # words that must join from the left
    held = agree(ranks, start - need, start - need + period, need)
    found: list[Run] = []
    last_end, known = -1, []
    for end, q, s in sorted(zip((start + 2 * period)[held].tolist(), period[held].tolist(), start[held].tolist(), strict=True)):
        if end != last_end:
            last_end, known = end, []
        if any(q % own == 0 and begin <= end - TIMES * q for own, begin in known):  # the same stretch by a multiple of its period
            continue
        begin = rotated(word, s, q)
        known.append((q, begin))
        found.append((begin, end - begin, q))
    return found


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text, given as word numbers, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    word = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    places = stretches(word, text)
    if not places:
        return out
    size = np.array([b - a for a, b in places])
    begin = np.cumsum(size + 1) - size - 1  # of each stretch in the forest; one word ends it
    forest = np.zeros(int(size.sum()) + len(places), dtype=np.int64)
    inside = np.ones(len(forest), dtype=bool)
    inside[begin + size] = False
    # words are told apart by stretch, so stretches share no prefix
    number = np.repeat(np.arange(len(places)), size)
    forest[inside] = number * (int(word.max()) + 2) + 1 + word[np.concatenate([np.arange(a, b) for a, b in places])]
    forest[~inside] = np.arange(len(places)) * (int(word.max()) + 2)
    first = np.cumsum([0, *(len(t) for t in texts)])
    for start, length, period in forest_runs(forest):
        i = int(np.searchsorted(begin, start, side="right")) - 1
        at = places[i][0] + start - int(begin[i])
        owner = int(text[at])
        out[owner].append((at - int(first[owner]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: Iterable[Run]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def greatest(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period, the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_tail(key, n: int) -> np.ndarray | None:
    """Which words a document is read as: of one of ten ids, a tail that repeats some words of its own; else None (as they stand).

    With h the crc32 of the id in decimal and g = h // 10, these are ids with h % 10 = 0; the tail begins at a = g % n and
    repeats p = 1 + (n - a) // (3 + g % 8) words.
    """
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def told(words: list[bytes], runs: list[Run], texts: bool) -> tuple:
    kept = b" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()])
    start, length, period = greatest(runs) or (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    row = (len(runs), start, length, period, None if start is None else 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode()) if texts else row


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
COLUMNS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", RUNS), ("collapsed", pa.string())]
DDL = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", reread=None, with_texts: bool = False) -> DataFrame:
    """One row a row: id, n_runs, the greatest run (start, length, period, exponent_milli), digests of all runs and of the kept words.

    Words are what ASCII white space separates.  A run is a stretch of at least ``max(WORDS, TIMES * period)`` words of which
    words a period apart are the same and which no neighbour extends, with its smallest period; after its first period its
    words go.  ``reread`` (id, number of words) may give another order in which the words of a text are read.  With
    ``with_texts`` also ``runs`` and the ``collapsed`` text.  A null or empty text has no words: no runs, four nulls and the
    digests of nothing.  Texts are read whole, repeated rows give repeated rows, a null id stays, other columns are left out,
    so their names cannot clash, and an empty table gives an empty table.  Of equally great runs the first counts, then the
    shorter period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in parts(batch):
                places = [None if reread is None else reread(key, len(words)) for key, words in part]
                part = [(key, words if at is None else [words[i] for i in at.tolist()]) for (key, words), at in zip(part, places, strict=True)]
                number = pa.array([w for _, words in part for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy()
                ends = np.cumsum([len(words) for _, words in part])
                found = runs_of(np.split(number, ends[:-1]))
                out = [(key, *told(words, runs, with_texts)) for (key, words), runs in zip(part, found, strict=True)]
                arrays = [pa.array(list(v), k) for v, (_, k) in zip(zip(*out, strict=True), [("id", kind), *COLUMNS], strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *(c for c, _ in COLUMNS)][: len(arrays)])

    def parts(batch: pa.RecordBatch) -> Iterator[list]:
        """(id, words) of rows that have together about AT_ONCE words."""
        now, n = [], 0
        for i in range(batch.num_rows):
            words = (batch.column(1)[i].as_py() or "").encode().split()
            now.append((batch.column(0)[i].as_py(), words))
            n += len(words)
            if n >= AT_ONCE:
                yield now
                now, n = [], 0
        if now:
            yield now

    ready(docs.sparkSession)
    more = ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_texts else ""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_column]}, {DDL}{more}").withColumnRenamed("id", id_column)
