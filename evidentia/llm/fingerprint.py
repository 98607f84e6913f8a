"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text character by character: each character is written once or several times, as the
random bits of its class and the walk's clock say.  Two texts that agree again after an edit soon fall into step, so
small edit distance becomes small Hamming distance of the written strings.  Bits sampled from the written strings are
the fingerprint; bands of those bits find candidates, which are verified on the fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed, partitions, stored
from evidentia.llm.components import components, join_one

#: Independent walks, sampled bits of each, classes of characters, and the period of a class's random bits.
WALKS, BITS, CLASSES, PERIOD = 2, 256, 256, 4096
#: Rows and characters fingerprinted at a time; cells of a lockstep block; fewest texts that walk in lockstep.
ROWS, CHARS, CELLS, LEAST_LANES = 1024, 8_000_000, 3_000_000, 64
SLICE = 256
#: Likeness from which documents are near, and the share of the pairs just there that a band is to find.
NEAR, RECALL = 0.8, 0.92
#: Bits of a band at least; more where the entries that share one by chance would be over 4,096 on average.
BAND_BITS, CHANCE_BITS = 12, 12
#: Entries a task holds before it sends them, leaders that a bucket is thinned by, rows compared at a time.
FLUSH, LEADERS, BLOCK = 100_000, 8, 128
#: Rows of a bucket from which only those that share a piece of their fingerprints are compared.
CROWD = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: the one source of shared randomness."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(seed: int, *shape: int) -> np.ndarray:
    n = int(np.prod(shape))
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)).reshape(shape)


class Walks:
    """The shared randomness: per walk, how long each class stays at each clock, and where bits are sampled."""

    def __init__(self):
        self.stay, self.records = [], []
        for w in range(WALKS):
            moves = (_random(11 + w, CLASSES, PERIOD) >> np.uint64(63)).astype(bool)
            wait = np.empty((CLASSES, PERIOD), dtype=np.uint8)
            ahead = np.full(CLASSES, 8, dtype=np.int64)  # clocks up to the next move, never above 8
            for t in range(2 * PERIOD - 1, -1, -1):
                ahead = np.where(moves[:, t % PERIOD], 1, np.minimum(ahead + 1, 8))
                if t < PERIOD:
                    wait[:, t] = ahead
            self.stay.append(wait.tobytes())
            # Sample places: for any length the last record below it is uniform, and the same for like lengths.
            u = (_random(101 + w, BITS, 64) >> np.uint64(11)).astype(float) / 2.0**53
            places = np.zeros((BITS, 64))
            for k in range(1, 64):
                places[:, k] = np.minimum(np.floor((places[:, k - 1] + 1) / np.maximum(u[:, k], 1e-12)), 1e15)
                places[:, k] = np.maximum(places[:, k], places[:, k - 1] + 1)
            self.records.append(places.astype(np.int64))
        self.table = np.frombuffer(b"".join(self.stay), dtype=np.uint8)
        self.base = (np.arange(WALKS, dtype=np.int32) * CLASSES * PERIOD)[:, None]
        self.slots = np.arange(BITS)
        self.salt = _random(977, WALKS, BITS)

    def clocks(self, texts: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        """Per text and walk when each character is first written, and at the end the whole length: (WALKS, n + 1) arrays.

        ``starts`` (texts, WALKS) has the clocks to begin with.  Texts of like length walk in lockstep; a text too long to have
        company walks alone.
        """
        out: list[np.ndarray | None] = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            lanes = order[at : at + max(1, CELLS // (longest + 1))]
            if len(lanes) < LEAST_LANES <= len(order) - at or longest * len(lanes) > CELLS:
                lanes = lanes[:1]
            at += len(lanes)
            if len(lanes) < LEAST_LANES // 2:
                for i in lanes:
                    kinds = (texts[i] % CLASSES * PERIOD).tolist()
                    out[i] = np.asarray([list(accumulate(kinds, self.moves(w), initial=int(starts[i, w]))) for w in range(WALKS)])
                continue
            size = np.array([len(texts[i]) for i in lanes])
            kinds = np.zeros((longest, len(lanes)), dtype=np.int32)
            for j, i in enumerate(lanes):
                kinds[: size[j], j] = texts[i] % CLASSES * PERIOD
            alive = np.searchsorted(-size, -np.arange(longest), side="left").tolist()  # lanes with a character at each place
            clock = starts[lanes].T.astype(np.int32).copy()
            told = np.empty((longest + 1, WALKS, len(lanes)), dtype=np.int32)
            told[0] = clock
            for i, k in enumerate(alive):
                now = clock[:, :k]
                now += self.table[(now & (PERIOD - 1)) + kinds[i, :k] + self.base]
                told[i + 1, :, :k] = now
            for j, i in enumerate(lanes):
                out[i] = told[: size[j] + 1, :, j].T
        return out

    def moves(self, w: int):
        stay = self.stay[w]
        mask = PERIOD - 1
        return lambda at, c: at + stay[c | at & mask]

    def sample(self, codes: np.ndarray, clocks: np.ndarray) -> np.ndarray:
        """The sampled bits of the written strings of all walks."""
        if not len(codes):
            return np.zeros(WALKS * BITS, dtype=bool)
        i = np.empty((WALKS, BITS), dtype=np.int64)
        for w in range(WALKS):
            places = self.records[w]
            at = places[self.slots, (places < clocks[w, -1]).sum(axis=1) - 1]
            i[w] = np.searchsorted(clocks[w], at, side="right") - 1
        # a window of three characters and the slot decide the bit: chance agreement of single letters is rarer so
        before, here, after = codes[np.maximum(i - 1, 0)], codes[i], codes[np.minimum(i + 1, len(codes) - 1)]
        with np.errstate(over="ignore"):
            key = (here << np.uint64(42)) ^ (before << np.uint64(21)) ^ after
            return (_mix(key * np.uint64(0x9E3779B97F4A7C15) + self.salt) >> np.uint64(63)).astype(bool).ravel()

    @staticmethod
    def code_points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def fingerprints(self, texts: list[str], edits: list[tuple[int, str]] | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Bits of each text and, with edits (keep, tail), of ``text[:keep] + tail``; a shared beginning is walked once."""
        codes = [self.code_points(t) for t in texts]
        whole = self.clocks(codes, np.zeros((len(texts), WALKS), dtype=np.int64))
        wide = [c.astype(np.uint64) for c in codes]
        bits = [self.sample(c, k) for c, k in zip(wide, whole, strict=True)]
        if edits is None:
            return [(b, None) for b in bits]
        tails = [self.code_points(t) for _, t in edits]
        rest = self.clocks(tails, np.array([whole[i][:, keep] for i, (keep, _) in enumerate(edits)]).reshape(-1, WALKS))
        edited = []
        for i, (keep, _) in enumerate(edits):
            edited.append(self.sample(np.concatenate([wide[i][:keep], tails[i].astype(np.uint64)]), np.concatenate([whole[i][:, :keep], rest[i]], axis=1)))
        return list(zip(bits, edited, strict=True))


def hexed(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, 0 for what chance agreement would give (half of the bits) or less."""
    return max(0.0, 1.0 - 2.0 * float(np.count_nonzero(a != b)) / len(a))


def cuts_below(value, cuts: list[int], width: int = 32):
    """How many of the sorted cuts are not above the value: one search over every ``width``-th cut, one within."""
    if not cuts:
        return F.lit(0)
    array = lambda x: F.lit(x).cast("array<bigint>")
    count = lambda among: F.aggregate(among, F.lit(0), lambda s, c: s + (value >= c).cast("int"))
    start = F.greatest(count(array(cuts[::width])) - 1, F.lit(0)) * width
    return start + count(F.slice(array(cuts), start + 1, F.lit(width)))


def in_order(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, z, bucket, halo): rows dealt to id ranges, each range followed by the first row of the next lower one.

    Ranges come from quantiles of the ids, so only ids are read for them; texts are shuffled once, compressed (z).  Rows sort
    by descending id, ties by a hash of the text; within a partition the order is that of ``bucket``, ``halo``, descending id.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = base.select("id").where("id IS NOT NULL")
    kind = dict(docs.dtypes)[id_column]

    def packed(batches):
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in part.column(2)], pa.binary())], names=["id", "tie", "z"])

    texts = base.select("id", F.xxhash64("text").alias("tie"), "text").mapInArrow(packed, f"id {kind}, tie long, z binary")
    # a text is placed by the number that its first six bytes make, which rises with it
    place = F.conv(F.rpad(F.hex(F.substring(F.col("id").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long") if kind == "string" else F.col("id")
    cuts = sorted(set(ids.select(place.alias("id")).approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [int(c) for c in cuts]
    bucket = F.when(F.col("id").isNull(), 0).otherwise(1 + cuts_below(place, cuts))
    placed = texts.withColumn("bucket", bucket)
    # the first row of each range, by id alone: as many rows as ranges
    tops = {r["bucket"]: r["top"] for r in base.select("id").withColumn("bucket", bucket).groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    above = {b: order[(i - 1) % len(order)] for i, b in enumerate(order)}  # whose last row is followed by this range's first
    pairs = [F.lit(x) for b in order if tops[b] is not None for x in (int(b), int(above[b]))]
    if pairs:
        top = F.create_map(*[F.lit(x) for b in order if tops[b] is not None for x in (int(b), tops[b])])
        to = F.create_map(*pairs)
        is_top = F.col("id") == top[F.col("bucket")]
        is_top = F.coalesce(is_top, F.lit(False))
        if None in tops.values():
            is_top = is_top | F.col("id").isNull()
            to = F.create_map(*pairs, F.lit(0), F.lit(int(above[0])))
        dealt = F.when(is_top, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo")), F.struct(to[F.col("bucket")].alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))))
        placed = placed.select("id", "tie", "z", F.explode(dealt).alias("d")).select("id", "z", "d.bucket", "d.halo", "tie")
    else:
        placed = placed.select("id", "z", "bucket", F.explode(F.array(F.lit(False), F.lit(True))).alias("halo"), "tie")
    return placed.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", "halo", F.desc_nulls_last("id"), "tie").drop("tie")


def with_next(batches) -> Iterator[tuple]:
    """(id, text, next text) from the rows of in_order: one row is held back until its successor is seen."""
    held, done = None, None
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            cols = [c.slice(at, SLICE).to_pylist() for c in batch.columns]
            for key, z, bucket, halo in zip(*cols, strict=True):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                if held is not None and held[2] == bucket:
                    yield held[0], held[1], text
                    held = None
                if halo:
                    done = bucket  # what follows of this range's halo are ties of its first row
                elif done != bucket:
                    held = (key, text, bucket)
    assert held is None, "each range ends with a halo row"


def edit_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text, its edited text and the next document's text.

    The edited text replaces the last floor(n/2) code points by the first as many of the next document in descending id
    order (after the last comes the first; a sole document is its own next).  Returns (id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next).  Null texts are empty; an empty text has the zero
    fingerprint; rows of one id follow each other by a hash of the text; rows without an id come last.  Equal texts have equal
    fingerprints.  Texts of any length are walked whole; repeated rows stay.  Other columns are left out; an empty table
    gives an empty table.
    """

    def run(batches):
        walks = Walks()
        held: list[tuple] = []
        size = 0

        def told():
            edits = [(len(t) - len(t) // 2, following[: len(t) // 2]) for _, t, following in held]
            prints = walks.fingerprints([t for _, t, _ in held], edits)
            # the next row's fingerprint is mostly at hand
            other = [i for i, (_, _, following) in enumerate(held) if i + 1 == len(held) or held[i + 1][1] != following]
            after = [p[0] for p in prints[1:]] + [None]
            for i, (bits, _) in zip(other, walks.fingerprints([held[i][2] for i in other]), strict=True):
                after[i] = bits
            edited = [t[:keep] + tail for (_, t, _), (keep, tail) in zip(held, edits, strict=True)]
            cols = [
                [h[0] for h in held], [len(h[1]) for h in held], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
                [hexed(a) for a, _ in prints], [hexed(b) for _, b in prints], [likeness(a, b) for a, b in prints], [likeness(a, n) for (a, _), n in zip(prints, after, strict=True)],
            ]
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], names=names)

        for row in with_next(batches):
            held.append(row)
            size += len(row[1])
            if len(held) >= ROWS or size >= CHARS:
                yield told()
                held.clear()
                size = 0
        if held:
            yield told()

    from pyspark.sql.pandas.types import to_arrow_type

    ordered = in_order(docs, id_column, text)
    kind = to_arrow_type(ordered.schema["id"].dataType)
    schema = f"id {dict(docs.dtypes)[id_column]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def band_places(n_bits: int, entries: int, least: float = NEAR, recall: float = RECALL) -> np.ndarray:
    """(bands, bits): sampled places of the fingerprint, as many bands as the recall takes.

    A bit of two fingerprints of likeness l agrees with chance (1 + l) / 2.  Bands grow by a bit when the entries double, so
    that chance meetings stay in proportion to the entries.
    """
    width = min(n_bits, max(BAND_BITS, int(np.ceil(np.log2(max(entries, 2)))) - CHANCE_BITS))
    agree = ((1 + least) / 2) ** width
    bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))) if agree < 1 else 1
    rng = np.random.default_rng(23)
    places = np.concatenate([rng.permutation(n_bits) for _ in range(-(-bands * width // n_bits) + 1)])
    return np.array([rng.choice(n_bits, width, replace=False) if (b + 1) * width > n_bits else places[b * width : (b + 1) * width] for b in range(bands)])


def band_keys(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(entries, bands): the sampled bits of each band as a number."""
    keys = np.zeros((len(prints), len(places)), dtype=np.uint64)
    for b, band in enumerate(places):
        for p in band.tolist():
            keys[:, b] = keys[:, b] << np.uint64(1) | (prints[:, p >> 3] >> np.uint8(7 - (p & 7)) & np.uint8(1))
    return keys


def linked(prints: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Links (first of a class, other member) among the fingerprints (rows of 64-bit words) of a bucket: at most ``most`` bits differ.

    A few leaders are compared with all first, which joins a family of near copies at once; after that only rows that are not
    yet joined can link, and all of those are compared, in a crowd those that share a piece of the fingerprint.
    """
    label = np.arange(len(prints))

    def merge(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]

    apart = lambda i: np.bitwise_count(prints[i] ^ prints).sum(axis=1, dtype=np.int32) <= most
    if len(prints) > 2 * LEADERS:
        for _ in range(LEADERS):
            alone = np.flatnonzero(np.bincount(label, minlength=len(label))[label] == 1)
            if not len(alone):
                break
            merge(int(alone[0]), np.flatnonzero(apart(int(alone[0]))))

    def compare(rows: np.ndarray) -> None:
        """Link all near pairs of these rows."""
        for at in range(0, len(rows), BLOCK):
            now = label[rows]
            if (now == now[0]).all():
                break
            some = rows[at : at + BLOCK]
            near = np.bitwise_count(prints[some][:, None, :] ^ prints[rows[at:]][None, :, :]).sum(axis=2, dtype=np.int32) <= most
            near &= label[some][:, None] != label[rows[at:]][None, :]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                merge(int(some[i]), rows[at:][np.flatnonzero(near[i])])

    if len(prints) <= CROWD:
        compare(np.arange(len(prints)))
    else:
        # near ones differ in ``most`` bits at most, so of one more piece of the fingerprint than that they share one whole
        bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
        for piece in np.array_split(np.arange(bits.shape[1]), int(most) + 1):
            key = bits[:, piece].astype(np.int64) @ (1 << np.arange(len(piece)))
            order = np.argsort(key, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    compare(order[a:b])
    first = np.full(len(label), len(label))
    np.minimum.at(first, label, np.arange(len(label)))
    return [(i, j) for j, i in enumerate(first[label].tolist()) if i != j]


def near_links(entries: DataFrame, total: int, least: float = NEAR, recall: float = RECALL) -> DataFrame:
    """(a, b): links that span what is linked, in each bucket of a band, among the distinct fingerprints of ``entries`` (fp binary).

    A fingerprint is named by its md5: links are many in a family of near copies, and go through many rounds.
    """
    n = partitions(entries.sparkSession)
    wide = WALKS * BITS
    places = band_places(wide, total, least, recall)
    most = (1.0 - least) / 2 * wide

    def spread(batches):
        held: list[bytes] = []

        def packed():
            prints = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)
            keys = band_keys(prints, places)
            with np.errstate(over="ignore"):
                part = (_mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(places), dtype=np.uint64)) % np.uint64(n)).astype(np.int32).ravel()
            order = np.argsort(part, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(part)]
            cols: list[list] = [[], [], []]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, band = np.divmod(order[a:b], len(places))
                for c, v in zip(cols, (int(part[order[a]]), prints[i].tobytes(), band.astype("<u2").tobytes()), strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["part", "fps", "bands"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) * len(places) >= FLUSH:
                yield packed()
                held.clear()
        if held:
            yield packed()

    def solve(batches):
        rows = [(f, b) for batch in batches for f, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if not rows:
            return
        prints = np.frombuffer(b"".join(f for f, _ in rows), dtype=np.uint8).reshape(-1, wide // 8)
        bands = np.frombuffer(b"".join(b for _, b in rows), dtype="<u2")
        words = prints.view(np.uint64)
        for band in np.unique(bands).tolist():
            mine = np.flatnonzero(bands == band)
            key = band_keys(prints[mine], places[band : band + 1])[:, 0]
            order = np.argsort(key, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    at = mine[order[a:b]]
                    at = at[np.lexsort(words[at].T)]  # the same smallest ones head the stars of all bands
                    found += [(at[i], at[j]) for i, j in linked(words[at], most)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(prints[x[k]].tobytes()).digest() for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = entries.select("fp").mapInArrow(spread, "part int, fps binary, bands binary").repartitionById(n, F.col("part"))
    return dealt.select("part", "fps", "bands").mapInArrow(solve, "a binary, b binary")


def classes_of(prints: DataFrame, least: float = NEAR, recall: float = RECALL) -> DataFrame:
    """(fp, class_id, rows) of the distinct fingerprints in (id, fp binary); class_id is the smallest id reachable by links."""
    entries = checkpointed(prints.where("fp IS NOT NULL").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    found = components(near_links(entries, entries.count(), least, recall))
    rooted = checkpointed(entries.withColumn("node", F.unhex(F.md5("fp"))).join(found, "node", "left").drop("node"))
    groups = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    grouped = join_one(rooted.where("root IS NOT NULL").select("fp", "root", "rows"), groups, "root", rooted.where("root IS NOT NULL").count(), "n").select("fp", "class_id", "rows")
    return checkpointed(grouped.unionByName(rooted.where("root IS NULL").select("fp", F.col("least").alias("class_id"), "rows")))


def near_classes(prints: DataFrame, id_column: str = "doc_id", fingerprint: str = "fingerprint", least: float = NEAR, recall: float = RECALL) -> DataFrame:
    """All columns and class_id: fingerprints linked where they share a band of sampled bits and their likeness is at least ``least``.

    Equal fingerprints are one entry, so copies are never paired; a candidate is verified on the whole fingerprints.  class_id
    is the smallest id reachable; rows without a fingerprint are classes of their own, rows without an id name no class;
    repeated rows stay; other columns pass through, one called ``class_id`` before the added one; an empty table gives an empty
    table.  ``prints`` should be stored: it is read more than once.
    """
    names = [f"c{i}" for i in range(len(prints.columns))]
    at = dict(zip(prints.columns, names, strict=True))
    plain = prints.toDF(*names).withColumn("fp", F.unhex(at[fingerprint]))
    classes = classes_of(plain.select(F.col(at[id_column]).alias("id"), "fp"), least, recall)
    out = join_one(plain.where("fp IS NOT NULL"), classes, "fp", plain.count(), "rows").select(*names, "class_id")
    return out.unionByName(plain.where("fp IS NULL").select(*names, F.col(at[id_column]).alias("class_id"))).toDF(*prints.columns, "class_id")


def fingerprinted(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """edit_pairs with the class_id of each document's fingerprint, the smallest id reachable by near fingerprints.

    A null text is an empty one, with the zero fingerprint; empty texts are one class.  Texts are walked whole.  Rows of one id
    follow each other by a hash of the text; repeated rows stay and are one class; rows without an id come last and name no
    class.  Ids are numbers or text.  Other columns are left out, so their names cannot clash; an empty table gives an empty table.
    """
    hexes = ("edited_sha256", "fingerprint", "edited_fingerprint")
    told = edit_pairs(docs, id_column, text)
    kept = stored(told.withColumns({c: F.unhex(c) for c in hexes}))
    classes = classes_of(kept.select(F.col(id_column).alias("id"), F.col("fingerprint").alias("fp")))
    out = join_one(kept.withColumnRenamed("fingerprint", "fp"), classes, "fp", kept.count(), "rows").withColumnRenamed("fp", "fingerprint")
    return out.select(*(F.lower(F.hex(c)).alias(c) if c in hexes else c for c in told.columns), "class_id")
