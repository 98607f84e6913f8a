"""Line dedup by a deletion-neighbourhood join, in Spark expressions only.

A line is a sequence of units: of words, divided by single blanks, where it has MIN_WORDS or more, else of characters where it
has MIN_CHARS or more, so that text without blanks has units too.  A line goes when an earlier line of the corpus equals it,
whatever its length, or is a sequence of the same kind of unit within one edit (a unit inserted, left out or replaced).  Blank
lines stay.  Equal lines meet by hash.  Two lines one edit apart have the first or the last half of the shorter one's units in
common, so only lines that share such a half with another line emit variants: the line without each of its units, and the whole
line, as hashed keys.  Equal variants are joined, each group to its earliest line and each shortened line to the line it
becomes, and every pair's edit distance is verified on the units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed, stored

#: Units are words from this number of words on, else characters from this number of characters on; one edit of a shorter line
#: would be a large part of it, so of those only exact repeats go.
MIN_WORDS, MIN_CHARS = 5, 20
#: Sums of hashes are kept below this power of two; running sums are built in spans.
MASK, SPAN = (1 << 62) - 1, 256
#: Bits of the filter that spares most lines the way to the join: 16 a line, at most 2**24 (262,144 rows of 64 bits).
FILTER_BITS = 1 << 24


def units_of(line: Column, worded: Column) -> Column:
    """Words, or characters behind a line feed, which no word holds."""
    return F.when(worded, F.split(line, " ")).otherwise(F.transform(F.split(line, ""), lambda c: F.concat(F.lit("\n"), c)))


def running(values: Column) -> Column:
    """[0, v0, v0 + v1, ...], each below MASK; meant for short arrays."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array((F.element_at(acc, -1) + v).bitwiseAND(F.lit(MASK)))))


def span_sums(values: Column) -> Column:
    """Running sums within spans of SPAN values; with the running totals of the spans, any prefix sum is two look-ups."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SPAN).cast("int")), lambda b: running(F.slice(values, b * SPAN + 1, SPAN)))


def placed_hashes(words: str, back: int) -> Column:
    """A hash of each word with its place, counted from 0, less ``back``."""
    return F.transform(words, lambda w, k: F.xxhash64(w, k - back).bitwiseAND(F.lit(MASK)))


def sum_before(spans: Column, totals: Column, i: Column) -> Column:
    """The sum of the first i values."""
    b = F.floor(i / SPAN).cast("int")
    return (F.get(totals, b) + F.coalesce(F.get(F.get(spans, b), (i % SPAN).cast("int")), F.lit(0).cast("long"))).bitwiseAND(F.lit(MASK))


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows with k1, k2: 128 bits of (id, text), never null; equal rows share them."""
    return docs.withColumns({"k1": F.xxhash64(F.col(id_column), F.col(text)), "k2": F.xxhash64(F.lit(1), F.col(text), F.col(id_column))})


def lines_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, k1, k2, line_no, line, h1, h2) of all lines; h1, h2 are 128 bits of the line."""
    lines = keyed(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id", "text").select("id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), F.col("line"))})


def passing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose h1 may be among the wanted ones, by a bitmap of bounded size; a join must follow."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    slot = F.pmod("h1", F.lit(bits))
    table = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    return rows.withColumn("slot", slot).join(F.broadcast(table), F.shiftright("slot", 6) == F.col("cell")).where(F.expr("shiftright(bits, cast(slot & 63 AS int)) & 1") == 1).drop("slot", "cell", "bits")


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, gone array<int>): for each row that loses lines their numbers, from 0."""
    lines = lines_of(docs, id_column, text)
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    worded = F.col("words") >= min_words
    n = F.when(worded, F.col("words")).when(F.length("line") >= min_chars, F.length("line"))
    judged = lines.where(F.col("line").rlike(r"[^ \t\r\f]")).withColumn("words", words.cast("int")).withColumn("n", n.cast("int"))
    p, q = F.shiftright("n", 1), F.shiftright(F.col("n") - 1, 1)
    of_words = lambda m: F.xxhash64(m, F.call_function("substring_index", F.col("line"), F.lit(" "), m))
    of_chars = lambda m: F.xxhash64(m, F.lit(0), F.when(m > 0, F.substring("line", F.lit(1), m)).otherwise(F.substring("line", m, -m)))
    half = lambda m: F.when(F.col("n").isNotNull(), F.when(worded, of_words(m)).otherwise(of_chars(m)))
    sides = {"a1": half(p), "z1": half(-p), "a2": F.when(p != q, half(q)), "z2": F.when(p != q, half(-q))}
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2", "line_no")
    distinct = stored(judged.withColumns(sides).groupBy("h1", "h2", "a1", "z1", "a2", "z2").agg(F.min(place).alias("first"), F.count("*").alias("times")))

    # lines that share a half with another line
    halved = distinct.select("h1", "h2", "first", F.explode(F.array_compact(F.array("a1", "z1", "a2", "z2"))).alias("half"))
    shared = halved.select("half").groupBy("half").agg(F.count("*").alias("m")).where("m > 1").select("half")
    likely = checkpointed(halved.join(shared.hint("shuffle_hash"), "half", "left_semi").select("h1", "h2", "first").dropDuplicates(["h1", "h2"]))

    # their units, from where each stands first
    first = {x: F.col(f"first.{x}") for x in ("k1", "k2", "line_no")}
    at_first = (F.col("k1") == first["k1"]) & (F.col("k2") == first["k2"]) & (F.col("line_no") == first["line_no"])
    found = passing(lines.select("k1", "k2", "line_no", "line", "h1", "h2"), likely).join(likely, ["h1", "h2"]).where(at_first)
    near = checkpointed(found.dropDuplicates(["h1", "h2"]).select("h1", "h2", "first", units_of(F.col("line"), F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1 >= min_words).alias("w")).withColumn("n", F.size("w")))

    # variants: sums of hashes of (unit, place) before the missing unit, and of (unit, place - 1) after it
    sums = near.select("h1", "h2", "first", "n", *(placed_hashes("w", d).alias(f"g{d}") for d in (0, 1)))
    sums = sums.select("h1", "h2", "first", "n", *(span_sums(F.col(f"g{d}")).alias(f"s{d}") for d in (0, 1)))
    sums = sums.withColumns({f"t{d}": running(F.transform(f"s{d}", lambda x: F.element_at(x, -1))) for d in (0, 1)})
    before = lambda d, i: sum_before(F.col(f"s{d}"), F.col(f"t{d}"), i)
    total = lambda d: F.element_at(f"t{d}", -1)
    key = lambda n, x: F.xxhash64(n, x.bitwiseAND(F.lit(MASK)))
    without = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), key(F.col("n") - 1, before(0, i) + (total(1) - before(1, i + 1)).bitwiseAND(F.lit(MASK))).alias("key")))
    variants = checkpointed(sums.select("h1", "h2", "first", key(F.col("n"), total(0)).alias("whole"), without.alias("v")))
    shorter = variants.select("h1", "h2", "first", F.explode("v").alias("v")).select("h1", "h2", "first", "v.i", "v.key")
    line = F.struct("first", "h1", "h2")
    twice = variants.select(F.explode("v").alias("v")).groupBy("v.key", "v.i").agg(F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("hk"), F.col("i").alias("hi"))
    equal = checkpointed(shorter.join(twice.hint("shuffle_hash"), (F.col("key") == F.col("hk")) & (F.col("i") == F.col("hi"))).select("key", "i", line.alias("x")))
    heads = equal.groupBy("key", "i").agg(F.min("x").alias("head"))
    replaced = equal.join(heads, ["key", "i"]).where("x <> head").select(F.col("x").alias("late"), F.col("head").alias("early"))
    whole = variants.select(F.col("whole").alias("key"), line.alias("other"))
    cut = shorter.select("key", line.alias("x")).join(whole.hint("shuffle_hash"), "key").select(F.greatest("x", "other").alias("late"), F.least("x", "other").alias("early"))
    pairs = replaced.unionByName(cut).distinct()

    # verify on the units
    text_of = near.select("h1", "h2", "w")
    a = text_of.select(F.col("h1").alias("late_1"), F.col("h2").alias("late_2"), F.col("w").alias("wa"))
    b = text_of.select(F.col("h1").alias("early_1"), F.col("h2").alias("early_2"), F.col("w").alias("wb"))
    full = pairs.select(F.col("late.h1").alias("late_1"), F.col("late.h2").alias("late_2"), F.col("early.h1").alias("early_1"), F.col("early.h2").alias("early_2")).join(a, ["late_1", "late_2"]).join(b, ["early_1", "early_2"])
    near_gone = full.where(within_one(F.col("wa"), F.col("wb"))).select(F.col("late_1").alias("h1"), F.col("late_2").alias("h2")).distinct()

    # every place of a line that is gone, and all but the first place of a line that stays
    fate = distinct.where("times > 1").select("h1", "h2", first["k1"].alias("f1"), first["k2"].alias("f2"), first["line_no"].alias("f3"))
    none = F.lit(None).cast("long")
    decided = checkpointed(near_gone.select("h1", "h2", none.alias("f1"), none.alias("f2"), F.lit(-1).alias("f3")).unionByName(fate.join(near_gone, ["h1", "h2"], "left_anti")))
    kept = F.col("k1").eqNullSafe(F.col("f1")) & F.col("k2").eqNullSafe(F.col("f2")) & (F.col("line_no") == F.col("f3"))
    gone = passing(lines.select("h1", "h2", "k1", "k2", "line_no"), decided).join(decided.hint("shuffle_hash"), ["h1", "h2"]).where(~kept)
    return gone.groupBy("k1", "k2").agg(F.collect_set("line_no").alias("gone"))


def within_one(a: Column, b: Column) -> Column:
    """Whether one edit at most divides two arrays of units."""
    n, m = F.size(a), F.size(b)
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    long, short = F.when(n > m, a).otherwise(b), F.when(n > m, b).otherwise(a)
    less = F.least(n, m)

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(F.slice(x, 1, less), y, lambda u, v: u == v), False)
        return F.when(at == 0, less).otherwise(at - 1)

    return F.when(n == m, changed <= 1).when(F.abs(n - m) == 1, common(long, short) + common(F.reverse(long), F.reverse(short)) >= less).otherwise(False)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns, the text without its dropped lines, plus ``n_lines`` and ``n_dropped`` (long).

    "Earlier" is by id (rows without an id last), then row content, then line number.  A line is kept whole or dropped
    whole; blank lines (of blanks, tabs, carriage returns, form feeds or nothing) stay.  A null text stays null with no
    lines; an empty text is one empty line and stays.  Texts and lines of any length are treated alike.  Rows equal in id and
    text count as one and fare alike.  Other columns pass through, whatever their names; one called like an added one stands before
    it.  An empty table gives an empty table.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    c_id, c_text = names[docs.columns.index(id_column)], names[docs.columns.index(text)]
    lost = dropped_lines(plain, c_id, c_text, min_words, min_chars)
    joined = keyed(plain.withColumns({"id": F.col(c_id), "text": F.col(c_text)}), "id", "text").join(lost.hint("shuffle_hash"), ["k1", "k2"], "left")
    parts = F.split(c_text, "\n")
    # bound once by the outer transform, so that neither array is made again for each line
    stay = F.struct(parts.alias("parts"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")).alias("at"))
    rest = F.transform(F.array(stay), lambda s: F.array_join(F.transform(s["at"], lambda i: F.get(s["parts"], i)), "\n"))
    kept = F.when(F.col("gone").isNull(), F.col(c_text)).otherwise(F.get(rest, 0))
    out = joined.select(*(kept.alias(n) if n == c_text else F.col(n) for n in names), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    out = out.withColumns({"n_lines": F.greatest("n_lines", F.lit(0)), "n_dropped": F.greatest("n_dropped", F.lit(0))})
    return out.toDF(*docs.columns, "n_lines", "n_dropped")


#: DuckDB: the same rule on the units themselves; kind 2 is words, 1 characters, 0 lines with exact repeats only.
ORACLE = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts)))::BIGINT AS no FROM cut
), part AS (SELECT doc_id, no, line FROM lines WHERE regexp_matches(line, '[^ \t\r\f]')),
firsts AS (
  SELECT line, min((doc_id, no)) AS first FROM part GROUP BY line
), kinds AS (
  SELECT row_number() OVER (ORDER BY first) AS r, line, CASE WHEN len(string_split(line, ' ')) >= 5 THEN 2 WHEN len(line) >= 20 THEN 1 ELSE 0 END AS kind FROM firsts
), numbered AS (
  SELECT r, line, kind, CASE kind WHEN 2 THEN string_split(line, ' ') WHEN 1 THEN regexp_extract_all(line, '(?s).') END AS w FROM kinds
), shorter AS (
  SELECT r, kind, i, list_concat(w[1:i], w[i+2:]) AS v FROM (SELECT r, kind, w, unnest(range(len(w))) AS i FROM numbered WHERE kind > 0)
), gone AS (
  SELECT r FROM (SELECT r, min(r) OVER (PARTITION BY kind, v, i) AS e FROM shorter) WHERE e < r
  UNION SELECT greatest(s.r, n.r) FROM shorter s JOIN numbered n ON s.v = n.w AND s.kind = n.kind
), lost AS (
  SELECT p.doc_id, p.no FROM part p JOIN firsts f ON p.line = f.line JOIN numbered n ON n.line = f.line LEFT JOIN gone g ON g.r = n.r
  WHERE g.r IS NOT NULL OR (p.doc_id, p.no) <> f.first
), per AS (SELECT doc_id, list(no) AS nos FROM lost GROUP BY doc_id)
SELECT c.doc_id,
  CASE WHEN nos IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(nos, i::BIGINT)), lambda i: parts[i + 1]), chr(10)) END AS text,
  len(parts)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_dropped
FROM cut c LEFT JOIN per p ON c.doc_id = p.doc_id
"""
