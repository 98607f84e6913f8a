"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled, with their id sequences, into a shared-suffix automaton
whose arc outputs add up to the word's row in an id table.  The automaton is one flat block of bytes
that each Python worker maps; words outside it are merged exactly.  Encoding is therefore identical
with and without the lexicon: it only saves merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed

#: Rows that a worker turns into Python objects at once.
SLICE = 256
#: Entries of a worker's memo of words, emptied when full.
MEMO = 150_000
#: The order of a pair that is never merged, its rank where ranks are 32 bits, and bits of the bucket of a pair.
NEVER, NO_PAIR, BUCKETS = 1 << 62, np.iinfo(np.int32).max, 18
#: Words merged at once, and the bytes beyond which a word is merged alone.
AT_ONCE, LONG = 4_096, 32


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    where = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [where[b] for b in range(256)]


def newer_letters() -> str:
    """A character class of letters and digits that the tokenizer's older Unicode tables lack."""
    known, spans = regex.compile(r"[\p{L}\p{N}]"), []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) == "Cn" and known.match(ch):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]" if spans else "[^\\s\\S]"


class Bpe:
    """Exact byte-level BPE of a tokenizers file: words, merges, special strings and decoding."""

    def __init__(self, spec: dict):
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.text_of = {str(i): bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in [*vocab.items(), *self.special.items()]}
        self.first = [vocab[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]  # the order of a pair and what it makes
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        newer = spec["newer"]
        self.newer = regex.compile(newer)
        self.plain = regex.compile(pattern).findall
        # the same classes written out for texts of the first 256 code points, for the faster engine
        letter, digit, space = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
        self.latin = re.compile(rf" ?[{letter}]+|'(?:[sdmt]|re|ve|ll)| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        old = {"\\p{L}+": f"(?:(?!{newer})\\p{{L}})+", "\\p{N}+": f"(?:(?!{newer})\\p{{N}})+", "[^\\s\\p{L}\\p{N}]+": f"(?:[^\\s\\p{{L}}\\p{{N}}]|{newer})+"}
        self.careful = regex.compile("|".join(next((p.replace(k, v) for k, v in old.items() if p.endswith(k)), p) for p in pattern.split("|"))).findall

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return (self.careful if self.newer.search(text) else self.plain)(text)
        return self.latin(text)

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank first, the leftmost among equals."""
        ids = [self.first[b] for b in word]
        return self.merge_long(ids) if len(ids) > 64 else self.merge_short(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        """The order of each pair is looked up once and again only beside a merge."""
        get = self.merges.get
        orders = [get(pair, NEVER) for pair in pairwise(ids)]
        while orders:
            least = min(orders)
            if least == NEVER:
                break
            i = orders.index(least)
            ids[i : i + 2] = (least & 0xFFFFFFFF,)
            del orders[i]
            if i:
                orders[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(orders):
                orders[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, so that long words stay cheap."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(order, i, ids[i], ids[i + 1]) for i, order in enumerate(get(pair, NEVER) for pair in pairwise(ids)) if order != NEVER]
        heapq.heapify(heap)
        while heap:
            order, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = order & 0xFFFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (order := get((ids[p], ids[q]), NEVER)) != NEVER:
                    heapq.heappush(heap, (order, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[str]) -> str:
        """The text of ids written in decimal."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


class PairTable:
    """What each pair of adjacent ids merges to, for many pairs at a time."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        key = np.array([a << 32 | b for a, b in bpe.merges] or [NEVER], dtype=np.int64)
        order = np.array([*bpe.merges.values()] or [NEVER], dtype=np.int64)
        made = np.argsort(self.bucket(key), kind="stable")
        self.key, self.rank = np.append(key[made], -1), np.append((order[made] >> 32).astype(np.int32), NO_PAIR)
        self.begin = np.searchsorted(self.bucket(key[made]), np.arange((1 << BUCKETS) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.begin).max())
        self.made = np.zeros(int(self.rank[:-1].max()) + 1 if bpe.merges else 1, dtype=np.int32)
        if bpe.merges:
            self.made[self.rank[:-1]] = order[made] & 0xFFFFFFFF
        self.first = np.array(bpe.first, dtype=np.int32)

    @staticmethod
    def bucket(key: np.ndarray) -> np.ndarray:
        return (((key ^ (key >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NO_PAIR where it does not merge or an id is missing (-1)."""
        want = a.astype(np.int64) << 32 | b
        bucket = self.bucket(want)
        at, stop = self.begin[bucket], self.begin[bucket + 1]
        out = np.full(len(want), NO_PAIR, dtype=np.int32)
        live = np.flatnonzero(at < stop)
        for step in range(self.longest):
            live = live[at[live] + step < stop[live]]
            hit = live[self.key[at[live] + step] == want[live]]
            out[hit] = self.rank[at[hit] + step]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the words data[start : start + size], which are of like size.

        All words take one merge a round, the leftmost of the lowest rank.
        """
        width = max(int(size.max()), 1)
        column = np.arange(width + 1, dtype=np.int32)
        inside = column < size[:, None]
        ids = np.where(inside, self.first[data[np.where(inside, start[:, None] + column, start[:, None])]], -1).astype(np.int32)
        rank = np.full(ids.shape, NO_PAIR, dtype=np.int32)
        some = np.flatnonzero(inside[:, 1:].ravel())
        some += some // width  # each row has one column more
        rank.ravel()[some] = self.ranks(ids.ravel()[some], ids.ravel()[some + 1])
        final, place = np.full_like(ids, -1), np.arange(len(ids))
        while len(ids):
            at = rank.argmin(axis=1)
            row = np.arange(len(ids))
            least = rank[row, at]
            goes = least < NO_PAIR
            if not goes.all():
                final[place[~goes]] = ids[~goes]
                ids, rank, place, at, least = ids[goes], rank[goes], place[goes], at[goes], least[goes]
                row = row[: len(ids)]
            right = column > at[:, None]  # what stands right of the pair moves left by one
            ids[:, :-1] = np.where(right[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(right[:, :-1], rank[:, 1:], rank[:, :-1])
            ids[row, at] = self.made[least]
            rank[row, at] = self.ranks(ids[row, at], ids[row, at + 1])
            left = np.flatnonzero(at)
            rank[left, at[left] - 1] = self.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        kept = final >= 0
        return final[kept], kept.sum(axis=1)

    def ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, how many): the ids of word i are ids[first[i] : first[i] + how_many[i]]."""
        n = len(words)
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32, count=n + 1, offset=4 * words.offset) if n else np.zeros(1, dtype=np.int32)
        data = np.append(np.frombuffer(data or b"", dtype=np.uint8), np.uint8(0))  # an empty word may start where the last one ends
        size = np.diff(offsets)
        order = np.argsort(size, kind="stable")
        parts, many = [], np.zeros(n, dtype=np.int64)
        short = int(np.searchsorted(size[order], LONG, side="right"))
        for at in range(0, short, AT_ONCE):
            some = order[at : min(at + AT_ONCE, short)]
            made, many[some] = self.merge(data, offsets[some], size[some])
            parts.append(made)
        for i in order[short:].tolist():
            made = np.asarray(self.bpe.merge(data[offsets[i] : offsets[i + 1]].tobytes()), dtype=np.int32)
            many[i] = len(made)
            parts.append(made)
        first = np.zeros(n, dtype=np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        return np.concatenate([np.zeros(0, np.int32), *parts]), first, many


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, as flat arrays over one block of bytes.

    An arc's output is the number of words that sort before those under it, so the outputs along a
    word's path sum to its rank; equal tails are one state.  ``rows`` and ``ids`` hold rank -> ids.
    """

    PARTS = ("start", "final", "label", "target", "output", "rows", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        state = np.repeat(np.arange(len(self.start) - 1, dtype=np.int64), np.diff(self.start))
        self.key = state * 256 + self.label

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Insert words in byte order; freeze each branch that can grow no more, sharing equal states."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        frozen: list[tuple] = []
        counts: list[int] = []
        branch: list[list] = [[False, []]]  # along the last word: final, arcs of (label, frozen state)
        labels: list[int] = []

        def freeze(depth: int) -> None:
            while len(branch) > depth + 1:
                final, arcs = branch.pop()
                shape = (final, tuple(arcs))
                if shape not in register:
                    register[shape] = len(frozen)
                    frozen.append(shape)
                    counts.append(int(final) + sum(counts[s] for _, s in arcs))
                branch[-1][1].append((labels.pop(), register[shape]))

        last = b""
        for w in words:
            same = 0
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
            freeze(same)
            for b in w[same:]:
                labels.append(b)
                branch.append([False, []])
            branch[-1][0] = True
            last = w
        freeze(0)
        frozen.append((False, tuple(branch[0][1])))  # the root is the last state
        start, final, label, target, output = [0], [], [], [], []
        for is_final, arcs in frozen:
            final.append(is_final)
            smaller = int(is_final)
            for b, s in arcs:
                label.append(b)
                target.append(s)
                output.append(smaller)
                smaller += counts[s]
            start.append(len(label))
        rows = np.cumsum([0, *(len(entries[w]) for w in words)])
        ids = [i for w in words for i in entries[w]]
        raw = {"start": start, "final": final, "label": label, "target": target, "output": output, "rows": rows, "ids": ids}
        return cls({k: np.asarray(raw[k], dtype=np.int32) for k in cls.PARTS})

    def to_bytes(self) -> bytes:
        parts = [getattr(self, k) for k in self.PARTS]
        return np.asarray([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(p.astype(np.int32).tobytes() for p in parts)

    @classmethod
    def view(cls, block) -> Lexicon:
        """Arrays over a block (a file's map or an anonymous one); nothing is copied."""
        sizes, at, arrays = np.frombuffer(block, dtype=np.int64, count=len(cls.PARTS)), 8 * len(cls.PARTS), {}
        for k, n in zip(cls.PARTS, sizes.tolist(), strict=True):
            arrays[k] = np.frombuffer(block, dtype=np.int32, count=n, offset=at)
            at += 4 * n
        return cls(arrays)

    @classmethod
    def map_bytes(cls, data: bytes) -> Lexicon:
        """Map an anonymous block: what a broadcast brings needs no file in a machine's own folder."""
        block = mmap.mmap(-1, len(data))
        block.write(data)
        return cls.view(block)

    @classmethod
    def map_file(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls.view(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """Walk all words in lockstep; None for those that are not in the lexicon."""
        found: list[list[int] | None] = [None] * len(words)
        if not words or not len(self.key):
            return found
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.cumsum(size) - size
        live, state, rank, step = np.flatnonzero(size), np.full(len(words), len(self.start) - 2, dtype=np.int64), np.zeros(len(words), dtype=np.int64), 0
        while len(live):
            want = state[live] * 256 + text[at[live] + step]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[arc] == want
            live, arc = live[hit], arc[hit]
            rank[live] += self.output[arc]
            state[live] = self.target[arc]
            step += 1
            ended = size[live] == step
            for i in live[ended & (self.final[state[live]] == 1)].tolist():
                r = rank[i]
                found[i] = self.ids[self.rows[r] : self.rows[r + 1]].tolist()
            live = live[~ended]
        return found


class Encoder:
    """Encode whole texts through a lexicon, many at a time, with a bounded memo of words."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon, self.memo = bpe, lexicon, {}
        self.pairs = PairTable(bpe)

    def learn(self, words: set[str]) -> None:
        """Put the ids of words, written in decimal with commas, in the memo."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(words)
        unseen = []
        for w, ids in zip(new, self.lexicon.look_up([w.encode() for w in new]), strict=True):
            if ids is None:
                unseen.append(w)
            else:
                self.memo[w] = ",".join(map(str, ids))
        if unseen:  # merged together, a merge of each a round
            ids, first, many = self.pairs.ids_of(pa.array(unseen, pa.string()))
            text = list(map(str, ids.tolist()))
            for w, at, n in zip(unseen, first.tolist(), many.tolist(), strict=True):
                self.memo[w] = ",".join(text[at : at + n])

    def encode(self, texts: list[str]) -> list[str]:
        """All ids of each text, in decimal, joined by commas."""
        cut = self.bpe.cut
        parts = [cut.split(t) if cut and cut.search(t) else [t] for t in texts]  # special strings at odd places
        words = [[[p] if i % 2 else self.bpe.words(p) for i, p in enumerate(t)] for t in parts]
        self.learn({w for t in words for p in t[::2] for w in p})
        special, memo = self.bpe.special, self.memo
        return [",".join([memo[w] for w in t[0]] if len(t) == 1 else [str(special[w]) if i % 2 else memo[w] for i, p in enumerate(t) for w in p]) for t in words]


def chunks(part: list, most: int = 1_000_000) -> Iterator[list]:
    """Rows (id, text) in runs of bounded length of text, or of one row."""
    now, size = [], 0
    for row in part:
        now.append(row)
        size += len(row[1] or "")
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def load_spec(path: str) -> str:
    """What workers need of a tokenizer file, as JSON: vocabulary, merges, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return json.dumps({"added_tokens": spec["added_tokens"], "model": {k: spec["model"][k] for k in ("vocab", "merges")}, "newer": newer_letters()})


_BPE: dict[int, Bpe] = {}


def bpe_of(spec: str) -> Bpe:
    """One Bpe per worker process and vocabulary."""
    key = hash(spec)
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = Bpe(json.loads(spec))
    return _BPE[key]


def rows(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch as lists of values, a slice at a time."""
    for at in range(0, batch.num_rows, SLICE):
        yield list(zip(*(c.slice(at, SLICE).to_pylist() for c in batch.columns), strict=True))


def word_counts(docs: DataFrame, spec: str, text: str = "text", keep: int = 75_000, emit: int = 65_536) -> DataFrame:
    """Frequent words of all texts and their counts (word, n).

    Each task counts all its words by lossy counting over at most ``2 * keep`` entries, so its memory is bounded, and
    sends its ``emit`` most frequent ones; the sums meet in a shuffle of words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def count(batches):
        bpe, seen = bpe_of(shared.value), Counter()
        for batch in batches:
            for part in rows(batch):
                for (t,) in part:
                    seen.update(bpe.words(t or ""))
                    if len(seen) > 2 * keep:
                        least = sorted(seen.values(), reverse=True)[keep]
                        seen = Counter({w: n for w, n in seen.items() if n > least})
        top = heapq.nsmallest(emit, seen.items(), key=lambda x: (-x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, spec: str, text: str = "text", size: int = 131_072) -> bytes:
    """Frequent words with their ids, as the bytes of a Lexicon: the words counted more often than a number that leaves ``size`` at most.

    ``size`` bounds what the driver collects and broadcasts: words of up to 64 bytes, under 16 MB in all with their ids.  The number
    comes from how many words have each count, so no partition sends more than it has above it.
    """
    counts = checkpointed(word_counts(docs, spec, text).where((F.col("n") > 1) & (F.octet_length("word") <= 64)))
    least, words = 1, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size).collect():
        words += row["words"]
        if words > size:
            least = row["n"]
            break
    top = counts.where(F.col("n") > least).select("word").toArrow().column(0).to_pylist()
    bpe = bpe_of(spec)
    return Lexicon.build({w: bpe.merge(w) for w in (x.encode() for x in top)}).to_bytes()


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", lexicon_size: int = 131_072, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns (id, n_tokens, ids_sha256, decoded_sha256) and, on request, ``ids`` (array<int>) and ``decoded``.
    A null text counts as empty: no tokens, the digests of the empty string.  The special strings of the
    vocabulary are encoded as their ids.  Repeated rows give repeated rows; other columns are left out;
    an empty table gives an empty table.  Texts are never cut.
    """
    spark = docs.sparkSession
    spec = load_spec(vocabulary)
    shared = spark.sparkContext.broadcast(spec)
    block = spark.sparkContext.broadcast(compile_lexicon(docs, spec, text, lexicon_size))

    def run(batches):
        bpe = bpe_of(shared.value)
        encoder = Encoder(bpe, Lexicon.map_bytes(block.value))
        for batch in batches:
            for part in (c for r in rows(batch) for c in chunks(r)):
                out: list[list] = [[], [], [], [], [], []]
                for (key, _), joined in zip(part, encoder.encode([t or "" for _, t in part]), strict=True):
                    ids = joined.split(",") if joined else []
                    whole = bpe.decode(ids)
                    values = [key, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()]
                    for column, v in zip(out, [*values, list(map(int, ids)), whole] if with_ids else values, strict=False):
                        column.append(v)
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                n = 6 if with_ids else 4
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:n], kinds[:n], strict=True)], names=names[:n])

    kind = dict(docs.dtypes)[id_column]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)
