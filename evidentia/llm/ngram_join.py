"""N-gram Jaccard join over prefix trees: link documents whose word n-gram sets are near, exactly.

1. Every document's set becomes 48-bit hashes and a 128-bit class key; equal sets are one class from then on.
2. Grams are counted on the cluster by packed arrays.  A gram that one class alone has can be in no overlap: it is dropped,
   but counted.  The others get a global order, rare first.
3. A class needs an index entry only for the grams of its prefix that are left.  Classes that share one fall into a cluster.
4. Each cluster, pair of blocks of a large one, or gram of one that few strings hold together, is joined in a prefix tree over the ordered sets: a walk carries the
   overlaps with all members down shared paths and leaves subtrees that remaining lengths rule out, or that could only
   link what is linked already.
5. Links join the classes to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import checkpointed, partitions
from evidentia.llm.components import components, join_one

#: Grams a task holds before it sends them, slices that a bucket is sorted in, members of a block.
FLUSH, SUB, BLOCK = 400_000, 4, 512
#: A cluster is joined gram by gram where that copies its sets so many times less often.
LESS = 1.0
#: Words, and a quarter as many sets, that a worker remembers.
MEMO = 150_000
#: A gram in more than this share of a task's classes is counted there and does not travel by class.
HOT_SHARE, HOT_LEAST = 1 / 64, 64
KEY = np.dtype("V16")
TOP = np.uint64(0xFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept for reuse up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def gram_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word grams; A-Z are lower-cased, words are divided by ASCII white space.

    With fewer words the whole sequence is the one gram; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def class_key(grams: np.ndarray) -> bytes:
    """96 bits of an order-free hash of the set, and its size in the last four bytes."""
    a = int(mix(grams + np.uint64(0x51ED27)).sum())
    b = int(mix(grams ^ np.uint64(0xA5A5F00D12345)).sum()) & 0xFFFFFFFF
    return a.to_bytes(8, "big") + b.to_bytes(4, "big") + len(grams).to_bytes(4, "big")


def sizes_of(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 16)[:, 12:].copy().view(">u4").ravel().astype(np.int64)


PACKED = "bucket int, kind int, classes binary, counts binary, values binary, ids array<{}>"
#: Kinds of packed rows: grams by class; grams hot in a task; a class's grams with their places in the order; class keys; the
#: ids of documents with their class keys.
GRAMS, HOT, KNOWN, CLASS, ROWS = 0, 1, 2, 3, 4
MOST = 0xFFFF


NAMES = ["bucket", "kind", "classes", "counts", "values", "ids"]


def as_batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:5]), pa.array([r[5] if len(r) > 5 else None for r in rows], pa.list_(ids))], names=NAMES)


def by_run(bucket: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int, kind: int) -> list[tuple]:
    """Pack rows already sorted by (bucket, class id) into one row a bucket: ids, run lengths, ``width`` low bytes of each value."""
    out = []
    if not len(bucket):
        return out
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        c = ids[a:b]
        heads = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
        runs = np.diff(np.r_[heads, b - a])
        pieces = -(-runs // MOST)  # a run of more than 16 bits can count is several runs
        counts = np.full(pieces.sum(), MOST)
        counts[np.cumsum(pieces) - 1] = runs - (pieces - 1) * MOST
        out.append((int(bucket[a]), kind, np.repeat(c[heads], pieces).tobytes(), counts.astype("<u2").tobytes(), raw[a:b].tobytes()))
    return out


def unpacked(rows: list[tuple], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, class ids) of packed rows."""
    ids = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint64)
    counts = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u2")
    raw = np.frombuffer(b"".join(r[4] for r in rows), dtype=np.uint8).reshape(-1, width)
    values = np.zeros((len(raw), 8), dtype=np.uint8)
    values[:, :width] = raw
    return values.view(np.uint64).ravel(), np.repeat(ids, counts)


def buckets_of(batches) -> Iterator[list[tuple]]:
    """Rows of each bucket together; they come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            if row[0] != now:
                if held:
                    yield held
                now, held = row[0], []
            held.append(row)
    if held:
        yield held


def scaled(x: np.ndarray, parts: int) -> np.ndarray:
    """64-bit hashes to parts of equal shares, by their low 32 bits."""
    return ((x & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def spread(docs: DataFrame, k: int, id_column: str, text: str, n: int) -> DataFrame:
    """Packed grams of all sets, to the buckets of their hashes, and the ids of all rows with their class keys.

    In transit a class is the first 64 bits of its key; the key itself travels once.  Rows of ids are dealt out in turn.
    """
    kind_of_id = to_arrow_type(docs.schema[id_column].dataType)

    def run(batches):
        hashes, seen = WordHashes(), set()
        sets: list[np.ndarray] = []
        keys: list[bytes] = []
        held = 0

        def flush():
            g = np.concatenate(sets)
            table = np.frombuffer(b"".join(keys), dtype=np.uint64)[::2]
            cls = np.repeat(table, [len(s) for s in sets])
            token, bucket = g >> np.uint64(16), scaled(mix(g), n)
            out = []
            to = scaled(table, n)
            for part in np.unique(to).tolist():
                out.append((part, CLASS, b"", b"", b"".join(keys[i] for i in np.flatnonzero(to == part).tolist())))
            limit = max(HOT_LEAST, int(len(sets) * HOT_SHARE))
            if len(sets) > limit:
                order = np.argsort(g)
                run_ = np.r_[0, np.flatnonzero(np.diff(g[order])) + 1, len(g)]
                big = np.flatnonzero(np.diff(run_) > limit)
                if len(big):
                    hot = np.zeros(len(g), dtype=bool)
                    for i in big.tolist():
                        hot[order[run_[i] : run_[i + 1]]] = True
                    one = order[run_[big]]
                    one = one[np.argsort(bucket[one], kind="stable")]
                    out += by_run(bucket[one], np.zeros(len(one), dtype=np.uint64), token[one], 6, HOT)
                    # a class's hot grams go on by its id, with the last place in the order
                    c, t = cls[hot], token[hot]
                    o = np.lexsort((c, scaled(c, n)))
                    out += by_run(scaled(c, n)[o], c[o], t[o] | (TOP << np.uint64(48)), 8, KNOWN)
                    token, bucket, cls = token[~hot], bucket[~hot], cls[~hot]
            o = np.argsort(bucket, kind="stable")  # sets stand one after another, so classes stay together
            return out + by_run(bucket[o], cls[o], token[o], 6, GRAMS)

        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_keys = []
                for t in part.column(1):
                    s = gram_set(t.as_py(), k, hashes)
                    key = class_key(s)
                    all_keys.append(key)
                    if not len(s) or key in seen:
                        continue
                    if len(seen) > MEMO // 4:
                        seen.clear()
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
                    held += len(s)
                    if held >= FLUSH:
                        yield as_batch(flush(), kind_of_id)
                        sets.clear()
                        keys.clear()
                        held = 0
                yield as_batch([(turn % n, ROWS, b"", b"", b"".join(all_keys), part.column(0).to_pylist())], kind_of_id)
                turn += 1
        if sets:
            yield as_batch(flush(), kind_of_id)

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, PACKED.format(dict(docs.dtypes)[id_column]))


def count_grams(rows: DataFrame, n: int) -> DataFrame:
    """Per bucket: drop grams of one class, give the rest their place in the order, send them on to their classes."""
    kind_of_id = to_arrow_type(rows.schema["ids"].dataType.elementType)

    def placed(token, cls, hot_tokens):
        if not len(token):
            return token, cls
        order = np.argsort(token, kind="stable")
        token, cls = token[order], cls[order]
        same = np.diff(token) == 0
        twice = np.r_[same, False] | np.r_[False, same]
        if len(hot_tokens):
            twice |= np.isin(token, hot_tokens)
        token, cls = token[twice], cls[twice]
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        if not len(token):
            return token, cls
        new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
        token, cls = token[new], cls[new]
        first = np.r_[True, np.diff(token) != 0]
        df = np.diff(np.r_[np.flatnonzero(first), len(token)])[np.cumsum(first) - 1].astype(np.uint64)
        if len(hot_tokens):
            df[np.isin(token, hot_tokens)] = TOP
        keep = df >= 2
        return token[keep] | (np.minimum(df[keep], TOP) << np.uint64(48)), cls[keep]

    def run(batches):
        for held in buckets_of(batches):
            if on := [r for r in held if r[1] in (KNOWN, CLASS, ROWS)]:
                yield as_batch(on, kind_of_id)
            hot = [r for r in held if r[1] == HOT]
            grams = [r for r in held if r[1] == GRAMS]
            del held
            if not grams:
                continue
            token, cls = unpacked(grams, 6)
            hot_tokens = np.unique(unpacked(hot, 6)[0]) if hot else np.zeros(0, dtype=np.uint64)
            slices = [placed(token[part], cls[part], hot_tokens) for part in (token % np.uint64(SUB) == i for i in range(SUB))]
            code, cls = (np.concatenate([s[i] for s in slices]) for i in (0, 1))
            o = np.lexsort((cls, scaled(cls, n)))
            yield as_batch(by_run(scaled(cls, n)[o], cls[o], code[o], 8, KNOWN), kind_of_id)

    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, rows.schema)


def index_classes(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cls, n, codes, prefix) of the classes whose prefix holds a gram that another class has too, and (cls, n, id) of all rows.

    ``codes`` is null in the rows of documents.
    """
    kind_of_id = to_arrow_type(rows.schema["ids"].dataType.elementType)
    names = ["cls", "n", "codes", "prefix", "id"]

    def run(batches):
        for held in buckets_of(batches):
            for r in held:
                if r[1] == ROWS:
                    own = np.frombuffer(r[4], dtype=KEY)
                    none = [None] * len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary()), pa.array(sizes_of(own)), pa.array(none, pa.binary()), pa.array(none, pa.list_(pa.int64())), pa.array(r[5], kind_of_id)], names=names)
            keys = np.unique(np.frombuffer(b"".join(r[4] for r in held if r[1] == CLASS), dtype=KEY))
            known = [r for r in held if r[1] == KNOWN]
            if not known:
                continue
            code, cls = unpacked(known, 8)
            order = np.lexsort((code, cls))
            code, cls = code[order], cls[order]
            new = np.r_[True, (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])]  # a hot gram can come twice
            code, cls = code[new], cls[new]
            ids = np.ascontiguousarray(keys).view(np.uint64)[::2]
            by_id = np.argsort(ids, kind="stable")
            size = sizes_of(keys)
            cuts = np.r_[0, np.flatnonzero(cls[1:] != cls[:-1]) + 1, len(cls)]
            which = by_id[np.searchsorted(ids, cls[cuts[:-1]], sorter=by_id)]
            out: list[list] = [[], [], [], []]
            for a, b, c in zip(cuts[:-1].tolist(), cuts[1:].tolist(), which.tolist(), strict=True):
                total = int(size[c])
                left = total - -(-num * total // den) + 1 - (total - (b - a))
                if left > 0:
                    for column, v in zip(out, (keys[c].tobytes(), total, code[a:b].astype("<u8").tobytes(), code[a : min(b, a + left)].view(np.int64).tolist()), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64())), pa.array([None] * len(out[0]), kind_of_id)], names=names)

    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"cls binary, n long, codes binary, prefix array<long>, id {rows.schema['ids'].dataType.elementType.simpleString()}")


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A label per set, equal for sets joined by links; sets hold the shared grams in the global order, sizes count all grams.

    The sets in sorted order are a prefix tree: a node is a run of sets with a common beginning.  At a node the overlaps of its
    path with every set are its parent's plus those of the grams it adds.
    """
    g = len(sets)
    label = np.arange(g)
    grams, flat = np.unique(np.concatenate(sets), return_inverse=True)
    length = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(length)]
    ranks = [flat[start[i] : start[i + 1]] for i in range(g)]
    owner = np.repeat(np.arange(g), length)
    by_gram = np.argsort(flat, kind="stable")
    holders, at = owner[by_gram], np.r_[0, np.cumsum(np.bincount(flat, minlength=len(grams)))]
    order = sorted(range(g), key=lambda i: ranks[i].tolist())
    ranked, lengths, totals = [ranks[i] for i in order], length[order], sizes[order]
    order = np.array(order)
    stack = [(0, g, 0, np.zeros(g, dtype=np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = ranked[lo], ranked[hi - 1]
        upto = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:upto] != last[depth:upto])
        end = depth + (int(differ[0]) if len(differ) else upto - depth)
        if end > depth:
            overlap = overlap + np.bincount(np.concatenate([holders[at[r] : at[r + 1]] for r in first[depth:end].tolist()]), minlength=g)
        rest = np.minimum(int(lengths[lo:hi].max()) - end, length - overlap)
        alive = (overlap + rest) * (num + den) >= num * (sizes + int(totals[lo:hi].min()))
        here = label[order[lo:hi]]
        if (label[alive] == here[0]).all() and (here == here[0]).all():
            continue
        at_end = lo
        while at_end < hi and lengths[at_end] == end:
            me = order[at_end]
            linked = np.flatnonzero(overlap * (num + den) >= num * (sizes + sizes[me]))
            found = np.unique(label[np.append(linked, me)])
            if len(found) > 1:
                label[np.isin(label, found)] = found[0]
            at_end += 1
        child = at_end
        while child < hi:
            key, stop = ranked[child][end], child + 1
            while stop < hi and ranked[stop][end] == key:
                stop += 1
            stack.append((child, stop, end, overlap))
            child = stop
    return label


def join_units(units: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that span what is linked within each unit of rows (unit, i, j, cls, n, codes)."""

    def solve(held):
        sets = [np.frombuffer(x[2], dtype="<u8") for x in held]
        label = trie_join(sets, np.array([x[1] for x in held]), num, den)
        return [(held[i][0], held[j][0]) for i, j in enumerate(label.tolist()) if i != j]

    def run(batches):
        now, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for unit, i, j, cls, size, codes in zip(*(c.slice(at, 1024).to_pylist() for c in batch.columns), strict=True):
                    if (unit, i, j) != now:
                        if len(held) > 1:
                            yield links(solve(held))
                        now, held = (unit, i, j), []
                    held.append((cls, size, codes))
        if len(held) > 1:
            yield links(solve(held))

    def links(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    dealt = units.repartition(n, "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "cls")
    return dealt.mapInArrow(run, "a binary, b binary")


def link_classes(indexed: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of the classes that are linked to another class.

    A cluster is a unit, in blocks if it is large.  Where grams that few classes share have strung a cluster together, a unit
    is one of its grams instead: linked classes share one of their prefixes, and small units copy sets less often than all
    pairs of blocks of the cluster would.
    """
    n = partitions(indexed.sparkSession)
    entries = indexed.select("cls", F.explode("prefix").alias("code"))
    heads = checkpointed(entries.groupBy("code").agg(F.min("cls").alias("head"), F.count("*").alias("m")).where("m > 1"))
    clusters = checkpointed(components(entries.join(heads, "code").select(F.col("cls").alias("a"), F.col("head").alias("b"))))
    copies = lambda m: m * F.ceil(m / BLOCK)
    grams = heads.select(F.col("head").alias("node"), "m").join(clusters, "node").groupBy("root").agg(F.sum(copies(F.col("m"))).alias("by_gram"))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m")).join(grams, "root").select("root", "m", F.col("m").alias("rows"), (F.col("by_gram") < copies(F.col("m")) * LESS).alias("strung"))
    placed = checkpointed(join_one(clusters, checkpointed(sizes), "root", clusters.count(), "rows"))
    whole = placed.where("NOT strung").select(F.col("node").alias("cls"), F.concat(F.lit("c"), F.hex("root")).alias("unit"), "m")
    wide = placed.where("strung").select(F.col("node").alias("cls"))
    by_gram = entries.join(wide, "cls", "left_semi").join(heads.select("code", "m"), "code").select("cls", F.concat(F.lit("g"), F.hex("code")).alias("unit"), "m")
    members = whole.unionByName(by_gram).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).join(indexed.select("cls", "n", "codes"), "cls")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    units = members.withColumn("u", F.explode(pairs)).select("unit", "u.i", "u.j", "cls", "n", "codes")
    return components(join_units(units, n, num, den))


def near_groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): documents linked where den * |intersection| >= num * |union| of their k-word gram sets.

    Null and empty texts, and texts without words, have the empty set and are linked with nothing; texts of fewer than k words
    have one gram.  Equal sets are one class, so copies are linked whatever their number; component_id is the smallest id
    reachable.  Repeated rows repeat; a row without an id counts as a link but names no component.  Other columns are
    left out; an empty table gives an empty table; texts are never cut.
    """
    n = partitions(docs.sparkSession)
    found = checkpointed(index_classes(count_grams(spread(docs, k, id_column, text, n), n), n, num, den))
    seen = found.where("codes IS NULL").select("id", "n", "cls")
    linked = link_classes(found.where("codes IS NOT NULL").drop("id"), num, den)
    first = seen.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    rooted = checkpointed(first.join(linked.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least", "root", "rows"))
    sums = rooted.agg(F.count("root").alias("classes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    groups = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    grouped = join_one(rooted.where("root IS NOT NULL").select("cls", "root", "rows"), groups, "root", sums["classes"], "classes").select("cls", "component_id", "rows")
    named = checkpointed(grouped.unionByName(rooted.where("root IS NULL").select("cls", F.col("least").alias("component_id"), "rows")))
    out = join_one(seen.where("n > 0"), named, "cls", sums["rows"], "rows").select("id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(seen.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_column)


#: DuckDB, for sets of three words linked at 0.9, on the words themselves.
ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM worded)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS id, doc_id AS to_id FROM sizes UNION SELECT r.id, w.b FROM reached r JOIN ways w ON r.to_id = w.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT id, min(to_id) AS m FROM reached GROUP BY id) r ON r.id = d.doc_id
"""
