"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate so that largest inner product becomes smallest distance.  Centroids are fitted on a
bounded sample, level by level with a balance penalty, and joined in a neighbour graph that is built once and that every worker
holds; all vectors and queries, in lockstep, search it by beams.  A vector near a boundary is posted to several lists; a query
visits all lists whose centroid distance stays within a ratio of its nearest, and further ones until they are sure to hold
enough vectors: its beam is widened until it ends beyond the ratio.  Where vectors differ in length, distances to centroids
tell little; so a query also visits the lists that may hold a better score than its k-th in a sample: the centroid's score, and
a part of what the list's farthest vector could add.  Ratio and part are chosen on queries of the table that are compared with
every row; the whole of it misses nothing.  Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed, partitions

#: Fit: vectors a list, lists at most, vectors sampled for each list, and clusters that are fitted at once.
LIST_SIZE, MAX_LISTS, PER_LIST, AT_ONCE = 512, 32_768, 4, 128
#: Routing: neighbours a centroid has in the graph, entries of a search, and the least beam that it holds.
DEGREE, ENTRIES, BEAM = 24, 8, 32
#: Boundary vectors: lists at most, and the distance ratio up to which they are replicated.
REPLICAS, REPLICA_RATIO = 2, 1.06
#: Queries: the distance ratios that are tried, and how many queries are routed at a time.
RATIOS, ASKED = (1.0, 1.05, 1.1, 1.15, 1.25), 128
#: Vectors of the fit at least, where the table has them.
FIT = 20_000
#: Vectors of which a query's k-th score is a lower bound; queries that are compared with every row, and the share of their
#: neighbours whose lists must be visited.
HELD, TRIED, WANTED = 10_000, 256, 0.99
#: Postings and queries of a list that meet in one block.
BLOCK = 4096
#: Results that a task holds before it merges them, and those beyond which it sends what is merged.
FOUND = 200_000


def lift(vectors: np.ndarray, radius: float) -> np.ndarray:
    """Append sqrt(radius^2 - |v|^2); queries get 0 there instead."""
    rest = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0)


def fit_flat(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner of each vector): k-means whose assignment pays for full lists, so that list sizes stay near each other."""
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([(distances(sample[i : i + 2048], centres) + penalty).argmin(axis=1) for i in range(0, len(sample), 2048)])
        size = np.bincount(owner, minlength=k)
        for j in range(sample.shape[1]):
            total = np.bincount(owner, weights=sample[:, j], minlength=k)
            centres[:, j] = np.where(size > 0, total / np.maximum(size, 1), centres[:, j])
        near = ((sample - centres[owner]) ** 2).sum(axis=1).mean()
        penalty = 0.5 * penalty + 0.05 * near * (size * k / len(sample) - 1)
        for j in np.flatnonzero(size == 0):
            centres[j] = sample[rng.integers(len(sample))]
            penalty[j] = 0
    return centres, owner


def fit_centroids(sample: np.ndarray, k: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """Centres of about k lists; more than AT_ONCE are fitted in levels, each cluster taking its share of them."""
    rng = np.random.default_rng(7) if rng is None else rng
    k = min(k, len(sample))
    if k <= AT_ONCE:
        return np.unique(fit_flat(sample, k, rng)[0], axis=0)
    _, owner = fit_flat(sample, min(AT_ONCE, int(np.ceil(k / AT_ONCE)) + 1), rng)
    parts = [sample[owner == j] for j in np.unique(owner)]
    if len(parts) == 1:  # copies of one vector
        return parts[0][:1]
    return np.unique(np.concatenate([fit_centroids(x, max(1, round(k * len(x) / len(sample))), rng) for x in parts]), axis=0)


def neighbour_graph(centres: np.ndarray) -> np.ndarray:
    """(k, degree): the nearest other centroids of each, some replaced by long arcs that keep the graph connected."""
    k = len(centres)
    degree = min(DEGREE, k - 1)
    near = np.empty((k, degree), dtype=np.int32)
    if degree:
        for i in range(0, k, 1024):
            d = distances(centres[i : i + 1024], centres)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        arcs = max(1, degree // 6)
        near[:, -arcs:] = np.random.default_rng(11).integers(0, k, (k, arcs))
    return near


class Router:
    """Centroids and their neighbour graph, searched by beams in lockstep."""

    def __init__(self, centres: np.ndarray, near: np.ndarray):
        self.centres, self.near = centres, near
        self.norms = (centres**2).sum(axis=1)
        self.entry = np.unique(np.linspace(0, len(centres) - 1, min(len(centres), ENTRIES)).astype(np.int32))

    def nearest(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest centroids found for each row, nearest first, with squared distances."""
        k = len(self.centres)
        want = min(want, k)
        width = min(k, max(BEAM, want))
        beam = np.zeros((len(x), width), dtype=np.int32)
        dist = np.full((len(x), width), np.inf)  # places not yet filled are infinitely far
        first = min(width, len(self.entry))
        beam[:, :first], dist[:, :first] = self.entry[:first], distances(x, self.centres[self.entry[:first]])
        own = (x**2).sum(axis=1)
        done, seen = np.zeros((len(x), k), dtype=bool), np.zeros((len(x), k), dtype=bool)
        seen[:, self.entry[:first]] = True
        live = np.arange(len(x))
        while len(live):
            open_ = np.where(done[live[:, None], beam[live]], np.inf, dist[live])
            j = open_.argmin(axis=1)
            more = np.isfinite(open_[np.arange(len(live)), j])
            live, j = live[more], j[more]
            if not len(live):
                break
            node = beam[live, j]
            done[live, node] = True
            new = self.near[node]
            dn = own[live, None] - 2 * np.einsum("nd,nkd->nk", x[live], self.centres[new]) + self.norms[new]
            dn = np.where(seen[live[:, None], new], np.inf, np.maximum(dn, 0))
            order = np.argsort(new, axis=1, kind="stable")  # a long arc may repeat a neighbour
            twice = np.zeros_like(seen[live[:, None], new])
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(new, order, axis=1), axis=1) == 0, axis=1)
            dn[twice] = np.inf
            seen[live[:, None], new] = True
            every, dall = np.concatenate([beam[live], new], axis=1), np.concatenate([dist[live], dn], axis=1)
            keep = np.argpartition(dall, width - 1, axis=1)[:, :width]
            beam[live], dist[live] = np.take_along_axis(every, keep, axis=1), np.take_along_axis(dall, keep, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(beam, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def visits(self, queries: np.ndarray, radius: float, ratio: float, width: int, adds: np.ndarray, least: int, probes: int | None = None) -> list[np.ndarray]:
        """The lists of each query, nearest first: those within the ratio, and as many as are sure to hold ``least`` ids.

        A query whose beam ends within the ratio, or holds too few, searches again with twice the beam, in the end all lists.
        """
        out: list[np.ndarray | None] = [None] * len(queries)
        rest = np.arange(len(queries))
        k = len(self.centres)
        while len(rest):
            x = np.concatenate([queries[rest], np.zeros((len(rest), 1))], axis=1)
            lists, far = self.nearest(x, width)
            found = np.isfinite(far)
            d = above_floor(far, queries[rest], radius)
            within = (d <= ratio**2 * np.maximum(d[:, :1], 0) + 1e-12) & found
            if probes is not None:
                within[:, probes:] = False
            held = np.where(found, adds[lists], 0)
            keep = within | (found & (np.cumsum(held, axis=1) - held < least))
            settled = (~within[:, -1] & (held.sum(axis=1) >= least)) | (lists.shape[1] >= k)
            for i in np.flatnonzero(settled):
                out[rest[i]] = lists[i][keep[i]]
            rest, width = rest[~settled], min(k, 2 * width)
        return out


def replicated(d: np.ndarray) -> np.ndarray:
    """Which of the lists nearest to a vector it is posted to."""
    keep = d <= REPLICA_RATIO**2 * d[:, :1] + 1e-12
    keep[:, 0] = True
    return keep


def above_floor(d: np.ndarray, queries: np.ndarray, radius: float) -> np.ndarray:
    """Squared distances less the least that a lifted vector can have to the query."""
    return d - np.abs(radius - np.sqrt((queries**2).sum(axis=1)))[:, None] ** 2


class Bounds:
    """What a list may hold at most for a query, as a part of the reach of its farthest vector.

    ``ids`` and ``held`` are vectors of the table, each id once; the k-th best score among them is no more than that in the table.
    """

    def __init__(self, centres: np.ndarray, reach: np.ndarray, radius: float, ids: np.ndarray, held: np.ndarray):
        self.centres, self.reach, self.ids, self.held = centres[:, :-1], reach + 1e-9 * radius, ids, held

    def parts(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Per query and list the least part of the list's reach that takes its centroid's score to the query's k-th; 1 or less if it can."""
        scores = queries @ self.held.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        kth = np.partition(scores, len(self.ids) - k, axis=1)[:, len(self.ids) - k] if len(self.ids) >= k else np.full(len(ids), -np.inf)
        return (kth[:, None] - queries @ self.centres.T) / (np.sqrt((queries**2).sum(axis=1))[:, None] * self.reach)


def choose_probing(router: Router, parts: np.ndarray, queries: np.ndarray, radius: float, adds: np.ndarray, least: int, truth: list[list[np.ndarray]]) -> tuple[float, float]:
    """(ratio, part) by which WANTED of the neighbours of some queries stand in a visited list, with the fewest visits.

    ``truth`` has, for each query, the lists of each of its neighbours.
    """
    if not any(truth):
        return RATIOS[-1], 1.0
    tried = []
    for ratio in RATIOS:
        need, within = parts.copy(), router.visits(queries, radius, ratio, BEAM, adds, least)
        for i, lists in enumerate(within):
            need[i, lists] = -np.inf
        each = np.array([need[i, lists].min() for i, near in enumerate(truth) for lists in near])
        part = min(1.0, float(np.sort(each)[int(np.ceil(WANTED * len(each))) - 1]))
        tried.append((int((need <= part).sum()), ratio, part))
    return min(tried)[1:]


def valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: no null id, all components finite, not zero."""
    v = F.col(column).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def also(lists: np.ndarray, parts: np.ndarray, part: float, probes: int | None) -> np.ndarray:
    """The lists and those whose bound is reached by the part, the likeliest first, up to ``probes`` in all."""
    more = np.setdiff1d(np.flatnonzero(parts <= part), lists)
    more = more[np.argsort(parts[more], kind="stable")]
    return np.concatenate([lists, more if probes is None else more[: max(0, probes - len(lists))]]).astype(np.int32)


def neighbour_lists(posted: DataFrame, asked, kind: str, k: int) -> list[list[np.ndarray]]:
    """For each of the broadcast (ids, queries) the lists of each of its k nearest ids, by comparison with every posting."""
    most = 2 * REPLICAS * k

    def run(batches):
        ids, queries = asked.value
        best = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0), dtype=np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists, own = part.column(0).to_numpy(), part.column(1).to_numpy()
                if not len(own):
                    continue
                cells = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=kind).reshape(len(own), -1).astype(float)
                scores = queries @ cells.T
                scores[ids[:, None] == own[None, :]] = -np.inf
                best = [np.concatenate([x, np.broadcast_to(y, scores.shape)], axis=1) for x, y in zip(best, (scores, own, lists), strict=True)]
                if best[0].shape[1] > most:
                    top = np.argpartition(-best[0], most - 1, axis=1)[:, :most]
                    best = [np.take_along_axis(x, top, axis=1) for x in best]
        scores, own, lists = best
        q = np.repeat(np.arange(len(ids), dtype=np.int32), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(own.ravel()), pa.array(lists.ravel()), pa.array(scores.ravel())], names=["q", "id", "list", "score"])

    if not len(asked.value[0]):
        return []
    found = posted.select("list", "id", "v").mapInArrow(run, "q int, id long, list int, score double").where(F.col("score") > float("-inf"))
    each = found.groupBy("q", "id", "list").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "list"))
    best: list[dict[int, tuple[float, list[int]]]] = [{} for _ in asked.value[0]]
    for r in each.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("q", "rank").select("q", "id", "list", "score").toArrow().to_pylist():
        mine = best[r["q"]]
        score, lists = mine.setdefault(r["id"], (r["score"], []))
        if r["score"] >= score - 1e-9 * abs(score):  # a posting of another vector of the id is no way to it
            lists.append(r["list"])
    return [[np.array(lists) for _, lists in list(mine.values())[:k]] for mine in best]


def search(vectors: DataFrame, k: int = 20, query_modulus: int = 20, id_column: str = "vec_id", column: str = "embedding", probes: int | None = None, probe_ratio: float | None = None) -> DataFrame:
    """The k nearest vectors of every query: (query_id, rank, vec_id, score).

    Queries are the rows whose id is divisible by ``query_modulus``; candidates every row but those with the query's id.
    Vectors null, zero or holding null or non-finite components take no part, nor do rows without an id, nor vectors of
    another dimension than the most common one (of two as common, the larger).  Rows that repeat an id count once, by the best of its vectors.  Ties of
    score go to the smaller id.  ``probe_ratio`` sets the ratio instead of choosing it, without a bound of scores; ``probes`` caps the lists of a query, but never below those that hold k other ids.  Other columns are left out; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    fine = valid(vectors, id_column, column)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("r")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    n, radius = sizes["n"], float(np.sqrt(sizes["r"]))
    base = fine.where(F.size("v") == sizes["d"])
    n_lists = min(MAX_LISTS, max(1, n // LIST_SIZE))
    fitted = n_lists * max(PER_LIST, min(FIT, n) // n_lists)
    picked = base.orderBy(F.xxhash64("vec_id"), "vec_id").select("v", "vec_id").limit(fitted + HELD).toArrow()
    picked, picked_ids = matrix(picked.column(0).combine_chunks()), picked.column(1).to_numpy()
    centres = fit_centroids(lift(picked[:fitted], radius), n_lists)
    near = neighbour_graph(centres)
    shared = sc.broadcast((centres, near, radius))

    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"  # what the table holds, without loss

    def packed(raw):
        return pa.array([c.tobytes() for c in raw.astype(kind)], pa.binary())

    def post(batches):
        centres, near, radius = shared.value
        router = Router(centres, near)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, raw = part.column(0).to_numpy(), matrix(part.column(1))
                if not len(ids):
                    continue
                lists, d = router.nearest(lift(raw, radius), REPLICAS)
                i, j = np.nonzero(replicated(d))
                away = np.sqrt(((raw[i] - centres[lists[i, j], :-1]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(lists[i, j].astype(np.int32)), pa.array(ids[i]), packed(raw[i]), pa.array(away)], names=["list", "id", "v", "away"])

    posted = checkpointed(base.mapInArrow(post, "list int, id long, v binary, away double"))
    # ids that each list adds when an id counts for its first list only: what some lists hold together is at least their sum
    adds = np.zeros(len(centres), dtype=np.int64)
    for r in posted.groupBy("id").agg(F.min("list").alias("list")).groupBy("list").count().collect():
        adds[r["list"]] = r["count"]
    portion, bounds = None, None
    if probe_ratio is None:
        reach = np.zeros(len(centres))
        for r in posted.groupBy("list").agg(F.max("away").alias("away")).collect():
            reach[r["list"]] = r["away"]
        once = np.unique(picked_ids[-HELD:], return_index=True)
        bounds = Bounds(centres, reach, radius, once[0], picked[-HELD:][once[1]])
        tried = base.where(F.col("vec_id") % query_modulus == 0).orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(TRIED).toArrow()
        ids, queries = tried.column(0).to_numpy(), matrix(tried.column(1).combine_chunks())
        truth = neighbour_lists(posted, sc.broadcast((ids, queries)), kind, k)
        probe_ratio, portion = choose_probing(Router(centres, near), bounds.parts(ids, queries, k), queries, radius, adds, k + 1, truth)
    held_by = sc.broadcast((adds, bounds))

    def ask(batches):
        centres, near, radius = shared.value
        router, (adds, bounds) = Router(centres, near), held_by.value
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                ids, raw = part.column(0).to_numpy(), matrix(part.column(1))
                if not len(ids):
                    continue
                lists = router.visits(raw, radius, probe_ratio, BEAM, adds, k + 1, probes)  # the query's own id is one of them
                if bounds is not None:
                    lists = [also(*x, portion, probes) for x in zip(lists, bounds.parts(ids, raw, k), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), packed(raw), pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asking = checkpointed(base.where(F.col("vec_id") % query_modulus == 0).mapInArrow(ask, "id long, v binary, lists array<int>"))
    asked = asking.select(F.explode("lists").alias("list"), F.lit(0).alias("kind"), "id", "v")
    every = posted.select("list", F.lit(1).alias("kind"), "id", "v").unionByName(asked)
    # blocks: a list with many postings or queries is cut into pieces, each pair of pieces a unit of its own
    sizes = every.groupBy("list").agg(F.ceil(F.sum("kind") / BLOCK).cast("int").alias("p"), F.ceil(F.sum(1 - F.col("kind")) / BLOCK).cast("int").alias("q")).where("p > 0 AND q > 0")
    slot = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("kind") == 1, F.col("q")).otherwise(F.col("p")) - 1)
    placed = every.join(F.broadcast(sizes), "list").withColumn("slot", slot).withColumn("other", F.explode(other))  # sizes: MAX_LISTS rows at most
    units = placed.select("list", F.when(F.col("kind") == 1, F.col("slot")).otherwise(F.col("other")).alias("pb"), F.when(F.col("kind") == 1, F.col("other")).otherwise(F.col("slot")).alias("qb"), "kind", "id", "v")

    def best(batches):
        unit, queries, postings = None, [], []
        found = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]  # query, vector, score
        held: list[list[np.ndarray]] = []
        rows = 0

        def solve():
            """The best of a unit for each of its queries."""
            ids = np.array([p[0] for p in postings])
            cells = np.frombuffer(b"".join(p[1] for p in postings), dtype=kind).reshape(len(postings), -1).astype(float)
            asked = np.frombuffer(b"".join(q[1] for q in queries), dtype=kind).reshape(len(queries), -1).astype(float)
            slack = 1e-9 * max(1.0, float(np.abs(cells).max()) * float(np.abs(asked).max()) * cells.shape[1])
            start = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1]  # rows of an id stand together
            for at in range(0, len(asked), 256):
                rough = asked[at : at + 256] @ cells.T
                for i, row in enumerate(rough):
                    key = queries[at + i][0]
                    row[ids == key] = -np.inf
                    each = np.maximum.reduceat(row, start) if len(start) < len(row) else row
                    few = np.flatnonzero(row >= np.partition(each, len(each) - k)[len(each) - k] - slack) if len(each) > k else np.arange(len(row))
                    few = few[ids[few] != key]
                    # the score itself is one fixed sum of a pair, whatever block it is found in
                    scores = (cells[few] * asked[at + i]).sum(axis=1)
                    if len(start) < len(row):
                        held.append(k_best(np.full(len(few), key), ids[few], scores))
                    else:
                        top = np.lexsort((ids[few], -scores))[:k]
                        held.append([np.full(len(top), key), ids[few[top]], scores[top]])

        def k_best(q, v, s):
            """The k best vectors of each query, each id once by its best score."""
            order = np.lexsort((-s, v, q))
            q, v, s = q[order], v[order], s[order]
            new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.zeros(0, dtype=bool)
            q, v, s = q[new], v[new], s[new]
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            start = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1] if len(q) else np.zeros(0, dtype=np.int64)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) if len(q) else start
            return [x[rank < k] for x in (q, v, s)]

        def merged():
            """The k best of each query among all that this task has found; an id posted twice counts once."""
            q, v, s = (np.concatenate([found[i], *(h[i] for h in held)]) for i in range(3))
            held.clear()
            return k_best(q, v, s)

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for li, pb, qb, posting, key, raw in zip(*(c.slice(at, 4096).to_pylist() for c in batch.columns), strict=True):
                    if unit != (li, pb, qb):
                        if queries and postings:
                            solve()
                            rows += len(queries) * k
                        unit, queries, postings = (li, pb, qb), [], []
                    side = postings if posting else queries
                    if not side or side[-1] != (key, raw):  # rows that repeat an id and vector follow each other
                        side.append((key, raw))
                if rows > FOUND:
                    found, rows = merged(), 0
                    if len(found[0]) > FOUND:
                        yield batch_of()
                        found = [x[:0] for x in found]
        if queries and postings:
            solve()
        found = merged()
        yield batch_of()

    dealt = units.repartition(partitions(spark), "list", "pb", "qb").sortWithinPartitions("list", "pb", "qb", "kind", "id", "v")
    found = dealt.mapInArrow(best, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
