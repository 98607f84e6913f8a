"""Title mentions and their provisions in text nodes.

Titles are chosen longest first, ties by text, occurrences left to right; an occurrence counts where it touches no chosen one.
One automaton finds all titles of a dictionary in one pass over a text, in an Arrow table function that returns the nodes' keys
and flat arrays of what is asked for; texts never come back.  A dictionary that is too large for a worker is met by rolling
hashes of the text: a bitmap of title hashes that every task holds lets few places through, and only those are joined.  Nodes of
many catalogs meet their own dictionary in groups of both.  Either way a node's occurrences fall into runs that overlap, and each
run is settled by itself, so the work of a text grows in proportion to its length and its occurrences.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import OrderedDict, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.operators import rolling
from evidentia.workers import ready

#: The default provision form, look-ahead and markers of unnamed references, and the work budgets.
PROVISION, LOOKAHEAD = r"(?U)제\d+조(?:의\d+)?", 32
MARKERS = ["법", "규정", "고시", "훈령", "예규"]
MATCHES_PER_NODE = MATCHES_PER_DOCUMENT = 100_000
CANDIDATES_PER_NODE = CANDIDATES_PER_DOCUMENT = 10_000
#: Titles, and characters of them, up to which a worker holds a dictionary as an automaton.
AUTOMATON_TITLES, AUTOMATON_CHARS = 200_000, 4_000_000
#: Automata that a worker keeps, and characters of their titles in all; the least recently used goes first.
KEPT_AUTOMATA, KEPT_CHARS = 64, 4_000_000
#: Characters of a title that an automaton holds; of a longer one the rest is compared where they stand.
LONG_TITLE = 256
#: Nodes of one catalog that meet its dictionary in one group.
GROUP_NODES = 20_000

Hit = tuple[object, int, int]  # title (its number in a dictionary, or the text itself), start, end


class Dictionary(NamedTuple):
    """The distinct non-empty titles in order, and a digest of them."""

    titles: list[str]
    digest: bytes

    @classmethod
    def of(cls, titles: Iterable[str | None]) -> Dictionary:
        known = sorted({t for t in titles if t})
        return cls(known, hashlib.sha256("\0".join(known).encode("utf-8", "surrogatepass")).digest())


class Automata:
    """Automata of dictionaries in a Python process, by what they hold."""

    built: OrderedDict[bytes, tuple[object, int]] = OrderedDict()

    @classmethod
    def of(cls, dictionary: Dictionary):
        kept = cls.built.get(dictionary.digest)
        if kept is not None:
            cls.built.move_to_end(dictionary.digest)
            return kept[0]
        made, long = ahocorasick.Automaton(), defaultdict(list)
        for i, t in enumerate(dictionary.titles):
            if len(t) < LONG_TITLE:
                made.add_word(t, (i, len(t)))
            else:
                long[t[:LONG_TITLE]].append(i)
        for t, numbers in long.items():
            made.add_word(t, numbers)
        made.make_automaton()
        cls.built[dictionary.digest] = made, sum(map(len, dictionary.titles))
        while len(cls.built) > 1 and (len(cls.built) > KEPT_AUTOMATA or sum(n for _, n in cls.built.values()) > KEPT_CHARS):
            cls.built.popitem(last=False)
        return made


def examined(found: Iterable[tuple[object, int, int]]) -> Iterator[Hit]:
    """Of each title, whose (title, start, end) come in ascending order, those that do not overlap its last examined one."""
    free: dict[object, int] = {}
    for title, start, end in found:
        if start >= free.get(title, 0):
            free[title] = end
            yield title, start, end


def occurrences(text: str, dictionary: Dictionary) -> list[Hit]:
    """All examined occurrences of the titles of a dictionary in a text, titles by number."""
    if not dictionary.titles:
        return []

    def found() -> Iterator[Hit]:
        for last, what in Automata.of(dictionary).iter(text):
            if what.__class__ is tuple:
                yield what[0], last + 1 - what[1], last + 1
            else:
                start = last + 1 - LONG_TITLE
                for i in what:
                    if text.startswith(dictionary.titles[i], start):
                        yield i, start, start + len(dictionary.titles[i])

    return list(examined(found()))


def runs(hits: list[Hit]) -> Iterator[list[Hit]]:
    """Hits by start, cut where no hit reaches over; hits of different runs cannot touch."""
    run: list[Hit] = []
    reach = 0
    for h in sorted(hits, key=lambda h: h[1]):
        if run and h[1] >= reach:
            yield run
            run, reach = [], 0
        run.append(h)
        reach = max(reach, h[2])
    if run:
        yield run


class Spans:
    """Disjoint spans by start."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        """Whether no span touches [start, end): the last one that begins before its end is the only one that could."""
        i = bisect_right(self.starts, end - 1)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def chosen(hits: list[Hit]) -> list[Hit]:
    """The selected hits by start."""
    out: list[Hit] = []
    for run in runs(hits):
        if len(run) == 1:
            out += run
            continue
        taken, kept = Spans(), []
        for h in sorted(run, key=lambda h: (h[1] - h[2], h[0], h[1])):  # numbers of titles rise with their texts
            if taken.free(h[1], h[2]):
                taken.add(h[1], h[2])
                kept.append(h)
        out += sorted(kept, key=lambda h: h[1])
    return out


def first_free(text: str, marker: str, taken: Spans) -> tuple[int | None, int]:
    """The first occurrence of a marker that touches no selected title, and how many were examined for it."""
    n = 0
    for m in re.finditer(re.escape(marker), text):
        n += 1
        if taken.free(m.start(), m.end()):
            return m.start(), n
    return None, n


def settled(text: str, hits: list[Hit], markers: list[str]) -> tuple[list[Hit], int | None, int]:
    """(selected hits, start of the unnamed reference, occurrences examined) of one node."""
    picked, taken = chosen(hits), Spans()
    taken.starts, taken.ends = [h[1] for h in picked], [h[2] for h in picked]
    marks = [first_free(text, m, taken) for m in markers]
    return picked, min((at for at, _ in marks if at is not None), default=None), len(hits) + sum(n for _, n in marks)


#: What can be asked for, as columns of the table function.
HITS = "array<struct<title:string,start:int,end:int>>"
COLUMNS = {
    "hits": f"hits {HITS}",
    "selected": "selected array<struct<start:int,end:int,title:string,next:int>>",
    "candidates": "bound array<struct<start:int,title:string,tail:string>>, unnamed int",
    "matches": "matches int",
}


class Asked(NamedTuple):
    """What is worked out for each node."""

    columns: tuple[str, ...]
    markers: list[str]
    lookahead: int

    def schema(self) -> str:
        return ", ".join(COLUMNS[c] for c in self.columns)

    def batch(self, texts: list[str | None], hits_of: Callable[[int, str], list[Hit]], name: Callable[[list], pa.Array]) -> list[pa.Array]:
        """The asked columns of some nodes as flat arrays with offsets; ``name`` gives the titles' texts."""
        every: list[Hit] = []
        picked: list[Hit] = []
        following: list[int] = []
        tails: list[str] = []
        hit_ends, pick_ends, unnamed, matches = [0], [0], [], []
        settle, tail = set(self.columns) - {"hits"}, "candidates" in self.columns
        for i, text in enumerate(texts):
            text = text or ""
            hits = hits_of(i, text)
            if "hits" in self.columns:
                every += hits
                hit_ends.append(len(every))
            if settle:
                mine, mark, n = settled(text, hits, self.markers)
                unnamed.append(mark)
                matches.append(n)
                if settle - {"matches"}:
                    then = [h[1] for h in mine[1:]] + [len(text)]
                    picked += mine
                    following += then[: len(mine)]
                    pick_ends.append(len(picked))
                    if tail:
                        tails += [text[e : min(e + self.lookahead, n)] for (_, _, e), n in zip(mine, then, strict=False)]
        ints = lambda values: pa.array(values, pa.int32())
        lists = lambda ends, **parts: pa.ListArray.from_arrays(ints(ends), pa.StructArray.from_arrays(list(parts.values()), list(parts)))
        starts, titles = ints([h[1] for h in picked]), name([h[0] for h in picked])
        out: list[pa.Array] = []
        for c in self.columns:
            if c == "hits":
                out.append(lists(hit_ends, title=name([h[0] for h in every]), start=ints([h[1] for h in every]), end=ints([h[2] for h in every])))
            elif c == "selected":
                out.append(lists(pick_ends, start=starts, end=ints([h[2] for h in picked]), title=titles, next=ints(following)))
            elif c == "candidates":
                out += [lists(pick_ends, start=starts, title=titles, tail=pa.array(tails, pa.string())), ints(unnamed)]
            else:
                out.append(ints(matches))
        return out

    def shaped(self, found: DataFrame, keep: list[str], provision: str) -> DataFrame:
        """The asked columns by their names; a provision is looked for in the tails."""
        columns = [c for c in self.columns if c != "candidates"]
        if "candidates" in self.columns:
            bound = F.transform("bound", lambda x: F.struct(x["start"].alias("start"), x["title"].alias("title"), F.nullif(F.regexp_extract(x["tail"], provision, 0), F.lit("")).alias("provision")))
            nothing = F.lit(None).cast("string")
            alone = F.struct(F.col("unnamed").alias("start"), nothing.alias("title"), nothing.alias("provision"))
            columns.append(F.when(F.col("unnamed").isNull(), bound).otherwise(F.array_sort(F.array_append(bound, alone))).alias("candidates"))
        return found.select(*keep, *columns)


def texts_of(titles: list[str]) -> Callable[[list], pa.Array]:
    """Title numbers to their texts."""
    known = pa.array(titles, pa.string())
    return lambda numbers: known.take(pa.array(numbers, pa.int32()))


def dictionary_of(titles: DataFrame | Dictionary, most: int) -> Dictionary | None:
    """The dictionary of a table's titles, or None where they are more than ``most`` or too long for a worker to hold."""
    if isinstance(titles, Dictionary):
        return titles if len(titles.titles) <= most and sum(map(len, titles.titles)) <= AUTOMATON_CHARS else None
    distinct = titles.select("title").where("title <> ''").distinct().limit(most + 1)
    size = distinct.agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars")).first()
    if size["n"] > most or (size["chars"] or 0) > AUTOMATON_CHARS:
        return None
    return Dictionary.of(r["title"] for r in distinct.collect())


def _schema(nodes: DataFrame, keep: list[str], asked: Asked) -> T.StructType:
    return T.StructType([nodes.schema[c] for c in keep] + T.StructType.fromDDL(asked.schema()).fields)


def _batches(nodes: DataFrame, keep: list[str], asked: Asked, hits_of, name) -> DataFrame:
    """``asked`` of nodes with ``text``: ``hits_of(batch)`` gives a function of row and text, ``name(batch)`` one of titles."""
    names = [f.name for f in _schema(nodes, keep, asked).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = asked.batch(batch.column("text").to_pylist(), hits_of(batch), name(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=names)

    ready(nodes.sparkSession)
    return nodes.mapInArrow(run, _schema(nodes, keep, asked))


def _found(nodes: DataFrame, titles: DataFrame | Dictionary, key: list[str], asked: Asked, text: bool, most: int | None = None) -> DataFrame:
    keep = [*key, *(["text"] if text else [])]
    nodes = nodes.select(*key, "text")
    dictionary = dictionary_of(titles, AUTOMATON_TITLES if most is None else most)
    if dictionary is not None:
        shared = nodes.sparkSession.sparkContext.broadcast(dictionary)
        return _batches(nodes, keep, asked, lambda _: lambda i, t: occurrences(t, shared.value), lambda _: texts_of(shared.value.titles))
    if isinstance(titles, Dictionary):
        titles = nodes.sparkSession.createDataFrame([(t,) for t in titles.titles], "title string")
    places = rolling.meetings(nodes, titles, key).withColumnsRenamed({c: f"met_{i}" for i, c in enumerate(key)})
    met = nodes.join(places, [nodes[c].eqNullSafe(places[f"met_{i}"]) for i, c in enumerate(key)], "left")

    def hits_of(batch: pa.RecordBatch):
        found = batch.column("met")
        flat = found.flatten()
        begins = [0, *accumulate(n or 0 for n in found.value_lengths().to_pylist())]
        places = list(zip(flat.field("start").to_pylist(), flat.field("title").to_pylist(), strict=True))
        # hashes can meet by chance, so the text itself has the say
        return lambda i, text: list(examined((t, s, s + len(t)) for s, t in sorted(places[begins[i] : begins[i + 1]]) if text.startswith(t, s)))

    return _batches(met, keep, asked, hits_of, lambda _: lambda texts: pa.array(texts, pa.string()))


def with_hits(nodes: DataFrame, titles: DataFrame | Dictionary, key: list[str], held: int | None = None) -> DataFrame:
    """(key, hits): all examined occurrences of the titles in nodes (``key`` and ``text``).

    ``held`` is how many titles a worker may hold as an automaton, AUTOMATON_TITLES at first; more are joined.
    """
    return _found(nodes, titles, key, Asked(("hits",), [], 0), False, held)


def mentions(nodes: DataFrame, titles: DataFrame | Dictionary, key: list[str], provision: str = PROVISION, lookahead: int = LOOKAHEAD, markers: list[str] = MARKERS, columns: tuple[str, ...] = ("candidates", "matches"), text: bool = False) -> DataFrame:
    """Keys of nodes (``key`` and ``text``) with the asked ``columns``, and with the text on request.

    selected: array<struct<start, end, title, next>>; candidates: array<struct<start, title, provision>> in text order, where a
    provision is looked for in the ``lookahead`` characters after a title and before the next, and where a node has at most one
    candidate without a title, at the first marker that touches no selected title; matches: occurrences examined.  A null
    text is empty.
    """
    asked = Asked(tuple(columns), markers, lookahead)
    keep = [*key, *(["text"] if text else [])]
    return asked.shaped(_found(nodes, titles, key, asked, text), keep, provision)


def catalog_mentions(nodes: DataFrame, titles: DataFrame, key: list[str], catalog: str = "catalog", provision: str = PROVISION, lookahead: int = LOOKAHEAD, markers: list[str] = MARKERS, columns: tuple[str, ...] = ("candidates", "matches"), group_nodes: int = GROUP_NODES) -> DataFrame:
    """``mentions`` where each node names its catalog and ``titles`` has (catalog, title): many dictionaries in one plan.

    Nodes and dictionaries meet in groups of a catalog, those of a catalog with many nodes in as many groups as keep a group below
    ``group_nodes`` nodes on average, its titles being copied to each; a dictionary that is longer than that makes groups as much
    larger, so copies never outweigh the nodes.  A worker keeps the automata of the catalogs it met last.  ``key`` must include
    what tells nodes apart; nodes of a catalog without titles, or without a catalog, have markers only.  Returns key and catalog
    with the asked columns.  A dictionary beyond what a worker holds is refused; such a catalog goes through ``mentions``.
    """
    asked = Asked(tuple(columns), markers, lookahead)
    keep = [*key, catalog] if catalog not in key else list(key)
    spark = nodes.sparkSession
    nodes = nodes.select(*keep, "text")
    known = titles.select(F.col(catalog).alias("c"), "title").where("title <> '' AND c IS NOT NULL").distinct()
    sizes = known.groupBy("c").agg(F.count("*").alias("n_titles"), F.sum(F.length("title")).alias("chars"))
    counted = nodes.groupBy(F.col(catalog).alias("c")).agg(F.count("*").alias("n_nodes")).join(sizes, "c", "left")
    groups = counted.select("c", F.greatest(F.lit(1), F.ceil(F.col("n_nodes") / F.greatest(F.lit(group_nodes), F.coalesce("n_titles", F.lit(0))))).cast("int").alias("groups"), (F.coalesce("n_titles", F.lit(0)) > AUTOMATON_TITLES).alias("large"))
    groups = groups.select("c", F.when(F.col("large"), F.raise_error(F.lit("a catalog has too many titles"))).otherwise(F.col("groups")).cast("int").alias("groups"))
    salt = F.pmod(F.xxhash64(*keep), F.coalesce("groups", F.lit(1))).cast("int")
    left = nodes.join(groups.where("c IS NOT NULL"), nodes[catalog] == F.col("c"), "left").select(*keep, "text", salt.alias("salt"))
    right = known.join(groups, "c").select(F.col("c").alias("of_catalog"), "title", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    schema = _schema(left, keep, asked)
    names = [f.name for f in schema.fields]

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        dictionary = Dictionary.of(theirs.column("title").to_pylist())
        name, out = texts_of(dictionary.titles), []
        for batch in mine.to_batches(max_chunksize=1000):
            made = asked.batch(batch.column("text").to_pylist(), lambda i, text: occurrences(text, dictionary), name)
            out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=names))
        return pa.Table.from_batches(out) if out else to_arrow_schema(schema).empty_table()

    ready(spark)
    met = left.groupBy(catalog, "salt").cogroup(right.groupBy("of_catalog", "salt")).applyInArrow(run, schema)
    return asked.shaped(met, keep, provision)


def candidates(found: DataFrame, document: str, order: list[str]) -> DataFrame:
    """(document, order..., start, title, provision, item_number) of all nodes in document order."""
    rows = found.select(document, *order, F.explode("candidates").alias("c")).select(document, *order, "c.start", "c.title", "c.provision")
    return rows.withColumn("item_number", F.row_number().over(Window.partitionBy(document).orderBy(*order, "start")))


def beyond_budget(over, matches_node: int = MATCHES_PER_NODE, matches_document: int = MATCHES_PER_DOCUMENT, candidates_node: int = CANDIDATES_PER_NODE, candidates_document: int = CANDIDATES_PER_DOCUMENT, n: Column | None = None) -> Column:
    """Whether a document is beyond a work budget; ``over`` makes an aggregate of its nodes that of the document.

    ``n`` is the number of a node's candidates, where those are not at hand.
    """
    n = F.size("candidates") if n is None else n
    return (over(F.max("matches")) > matches_node) | (over(F.sum("matches")) > matches_document) | (over(F.max(n)) > candidates_node) | (over(F.sum(n)) > candidates_document)


def over_budget(found: DataFrame, document: str, *budgets: int, **named: int) -> DataFrame:
    """Documents beyond a work budget (those of beyond_budget); such a document is void as a whole."""
    return found.groupBy(document).agg(beyond_budget(lambda c: c, *budgets, **named).alias("void")).where("void").select(document)


def lines_as_nodes(docs: DataFrame, document: str = "doc_id", text: str = "text") -> DataFrame:
    """(document, ordinal, text): lines numbered from 1 with the empty ones, which are then left out."""
    cut = docs.select(document, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return cut.select(document, (F.col("at") + 1).alias("ordinal"), F.col("line").alias("text")).where("text <> ''")
