"""Mixing sources to target weights by iterative proportional fitting.

Token masses of the cells source x language x topic are raked until the expected marginals of the sample meet the targets: a
cell's probability is the product of one factor a category, at most 1, and each step scales the factors of one dimension to its
targets.  The stated share of all tokens fixes the scale, so a rare cell is kept whole instead of lowering the chance of every
other document.  Documents are then drawn by a hash.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import checkpointed, stored

DIMS = ("source", "lang", "topic")
#: Parameters of the registered query and the pipeline.  A number is the power of the observed share that a category is to
#: have (0: equal shares, 1: as observed, more: small ones fall behind); ``*`` is what all categories not named share, in
#: proportion to their masses.  Named topics are texts with licence lines, secrets, personal data or menus in them, which the
#: sample is to have less of than the corpus.
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.12, "*": 0.02}, "topic": 1.25}
#: Share of all tokens to keep.
KEEP = 0.6
#: Default topics by their words, lower case; the topic with most of a text's words has the text, ties go to the first.
TOPICS = {
    "law": "license licensed licence licenses copyright warranty warranties rights reserved liability lizenz urheberrecht licencia derechos droits trademark agreement".split(),
    "software": "token password passwort secret api_key apikey key function import github software version code server login".split(),
    "contact": "+1 +33 +34 +39 +41 +43 +44 +49 email e-mail phone telephone tel telefon téléphone teléfono address contact kontakt contacto".split(),
    "navigation": "| » « home menu sitemap next previous login logout subscribe share comments cookies".split(),
}
OTHER = "general"
#: What may stand behind a word.
MARKS = ["", ".", ",", ";", ":", "!", "?", ")"]
#: Cells that are raked on the driver and broadcast; more are raked on the cluster by the same steps to the same end.
LOCAL_CELLS = 100_000
#: Rounds at most, change of a probability at which all have settled, and relative error of a marginal that counts as met.
ROUNDS, SETTLED, CLOSE = 500, 1e-12, 1e-6
#: A factor beyond this changes no probability.
LARGEST = 1e12

class NotMet(ValueError):
    """Targets that no sample of the wanted size can meet."""


def forms(words: list[str]) -> list[str]:
    """A word as it stands in texts: in small, initial or large letters, before a mark or none."""
    return sorted({w + m for x in words for w in (x, x.capitalize(), x.upper()) for m in MARKS})


def told_by_words(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """struct<tokens, topic> of a whole text: its words, which blanks and line feeds divide, and the topic most of them name.

    The text is cut once; each outer transform binds what it holds, so that nothing is computed again for a further use.
    """
    pieces = F.array(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1))
    known = ["", *(f for words in topics.values() for f in forms(words))]
    cut = F.transform(pieces, lambda w: F.struct(F.size(w).alias("n"), F.filter(w, lambda x: x.isin(known)).alias("found")))
    count = lambda found, words: F.size(F.filter(found, lambda x: x.isin(words)))
    hits = F.transform(cut, lambda c: F.struct((c["n"] - count(c["found"], [""])).alias("tokens"), F.array(*(F.struct(count(c["found"], forms(words)).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(topics.items()))).alias("hits")))
    best = F.transform(hits, lambda h: F.struct(h["tokens"].cast("long").alias("tokens"), F.array_max(h["hits"]).alias("best")))
    return F.get(F.transform(best, lambda b: F.struct(b["tokens"].alias("tokens"), F.when(b["best"]["n"] > 0, b["best"]["name"]).otherwise(F.lit(OTHER)).alias("topic"))), 0)


def label(c: Column) -> Column:
    """Categories as text; null is one of its own, apart from every value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def wanted_shares(masses: dict[str, float], target: dict | float) -> dict[str, float]:
    """The share of the sample that each category (a label) with mass is to have; they add up to 1."""
    total = sum(masses.values())
    if not isinstance(target, dict):
        raw = {k: (m / total) ** target for k, m in masses.items()}
    else:
        named = {k: target.get(k[1:] if k[0] == "=" else None) for k in masses}
        rest = sum(masses[k] for k, t in named.items() if t is None)
        raw = {k: float(target.get("*", 0.0)) * masses[k] / rest if t is None else float(t) for k, t in named.items()}
    if min(raw.values(), default=0) < 0 or not sum(raw.values()):
        raise ValueError("targets are negative, or none has mass")
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def rake_local(codes: np.ndarray, share: np.ndarray, targets: list[np.ndarray], keep: float) -> tuple[np.ndarray, float]:
    """(factors of the cells, largest relative error of a marginal): each round scales every dimension to its targets in turn."""
    factor = np.full(len(share), keep)
    for _ in range(ROUNDS):
        before = np.minimum(factor, 1)
        for d, target in enumerate(targets):
            now = np.bincount(codes[:, d], weights=share * np.minimum(factor, 1), minlength=len(target))
            factor = np.minimum(factor * np.divide(target * keep, now, out=np.zeros_like(now), where=now > 0)[codes[:, d]], LARGEST)
        if np.abs(np.minimum(factor, 1) - before).max() < SETTLED:
            break
    off = 0.0
    for d, target in enumerate(targets):
        now = np.bincount(codes[:, d], weights=share * np.minimum(factor, 1), minlength=len(target))
        off = max(off, float((np.abs(now - target * keep) / np.maximum(target * keep, SETTLED)).max()))
    return factor, off


def rake_cluster(cells: DataFrame, target: dict[str, DataFrame], keep: float) -> tuple[DataFrame, float]:
    """The same rounds for more cells than the driver should hold; ``target`` has (label, share) by dimension.

    Cells are read in each step and never written again: what changes is one factor a category, in a small table a dimension that
    the planner copies to all tasks while it is small.  Rounds end when no factor, or, asked for every few rounds, no probability
    changes any more.
    """
    factors = {d: stored(target[d].select(F.col("label").alias(d), F.lit(1.0).alias(f"f_{d}"))) for d in DIMS}

    def weighed(now: dict[str, DataFrame], name: str = "factor") -> DataFrame:
        out = cells
        for d in DIMS:
            out = out.join(now[d], d)
        product = F.col(f"f_{DIMS[0]}") * F.col(f"f_{DIMS[1]}") * F.col(f"f_{DIMS[2]}")
        return out.withColumn(name, F.least(product * keep, F.lit(LARGEST))).drop(*(f"f_{d}" for d in DIMS))

    def marginal(d: str) -> DataFrame:
        sums = weighed(factors).groupBy(d).agg(F.sum(F.col("share") * F.least("factor", F.lit(1.0))).alias("now"))
        return sums.join(target[d].withColumnsRenamed({"label": d, "share": "want"}), d).withColumn("want", F.col("want") * keep)

    for n in range(ROUNDS):
        before, moved = dict(factors), 0.0
        for d in DIMS:
            scale = F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0)
            step = marginal(d).join(factors[d], d).select(d, scale.alias("scale"), F.least(F.col(f"f_{d}") * scale, F.lit(LARGEST)).alias(f"f_{d}"))
            step = stored(step)
            moved = max(moved, step.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            factors[d] = step.drop("scale")
        if moved < SETTLED:
            break
        if n % 5 == 4:
            both = weighed(factors).join(weighed(before, "earlier").drop("share"), list(DIMS))
            if (both.agg(F.max(F.abs(F.least("factor", F.lit(1.0)) - F.least("earlier", F.lit(1.0))))).first()[0] or 0.0) < SETTLED:
                break
    error = F.abs(F.col("now") - F.col("want")) / F.greatest("want", F.lit(SETTLED))
    return weighed(factors), max(marginal(d).agg(F.max(error)).first()[0] or 0.0 for d in DIMS)


def mix(docs: DataFrame, targets: dict[str, dict | float] = TARGETS, keep: float = KEEP, seed: int = 17, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, local_cells: int = LOCAL_CELLS, strict: bool = True) -> DataFrame:
    """All columns plus topic, tokens, weight, probability and sampled (each named with the prefix ``mix_``).

    ``targets`` says by dimension (source, lang, topic) what share of the sample's tokens each category is to have, as in
    TARGETS; ``keep`` is the share of all tokens that the sample is to have.  ``weight`` is the cell's raked factor,
    ``probability`` the same but at most 1, ``sampled`` 1 where a hash of the seed and the id (of the text, where there is no
    id) falls below it, so repeated rows fare alike and a rerun draws the same.  Where the expected marginals miss the targets
    by more than CLOSE, because a category has too little mass or the cells exclude each other, NotMet is raised; without
    ``strict`` the nearest the rounds came is used, under a warning that tells the error.  Tokens are words between blanks and line feeds; a null or blank
    text of any length has none and belongs to no mass, but is sampled by its cell (probability 0 in a cell without mass).
    Null source or language is a category of its own.  An empty table gives an empty table.  Other columns pass through, whatever
    their names; one that is called like an added one stands before it, so both are there and are told apart by place.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    body = F.coalesce(F.col(text), F.lit(""))
    seen = docs.select(
        *(docs[c].alias(n) for c, n in at.items()),
        label(F.col(source)).alias("source"),
        label(F.col(lang)).alias("lang"),
        label(F.lit(None) if topic is None else topic).alias("topic"),
        told_by_words(body).alias("told"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("|"), body))).cast("binary")).alias("draw"),
    )
    seen = seen.select(*names, "source", "lang", (label(F.col("told.topic")) if topic is None else F.col("topic")).alias("topic"), F.col("told.tokens").alias("tokens"), "draw")
    cells = checkpointed(seen.groupBy(*DIMS).agg(F.sum("tokens").alias("mass")).where("mass > 0"))
    stats = cells.agg(F.count("*").alias("n"), F.sum("mass").alias("mass")).first()
    off = 0.0
    if not stats["n"]:
        factors = spark.createDataFrame([], "source string, lang string, topic string, factor double")
    elif stats["n"] <= local_cells:
        rows = sorted(cells.collect())
        levels = [sorted({r[d] for r in rows}) for d in DIMS]
        where = [{k: i for i, k in enumerate(x)} for x in levels]
        codes = np.array([[where[i][r[d]] for i, d in enumerate(DIMS)] for r in rows])
        mass = np.array([r["mass"] for r in rows], dtype=float)
        wanted = []
        for i, d in enumerate(DIMS):
            s = wanted_shares({k: float(mass[codes[:, i] == j].sum()) for k, j in where[i].items()}, targets.get(d, 1.0))
            wanted.append(np.array([s[k] for k in levels[i]]))
        factor, off = rake_local(codes, mass / mass.sum(), wanted, keep)
        table = pa.table({**{d: [r[d] for r in rows] for d in DIMS}, "factor": factor})
        factors = F.broadcast(spark.createDataFrame(table))  # LOCAL_CELLS rows at most
    else:
        target = {}
        for d in DIMS:
            marginal = cells.groupBy(F.col(d).alias("label")).agg((F.sum("mass") / float(stats["mass"])).alias("s"))
            rule = targets.get(d, 1.0)
            if isinstance(rule, dict):
                given = spark.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in rule.items() if k != "*"], "label string, t double")
                known = marginal.join(given, "label", "left")
                rest = known.where("t IS NULL").agg(F.sum("s")).first()[0] or 1.0
                raw = known.select("label", F.coalesce("t", F.col("s") * (float(rule.get("*", 0.0)) / rest)).alias("share"))
            else:
                raw = marginal.select("label", F.pow("s", F.lit(float(rule))).alias("share"))
            total = raw.agg(F.sum("share")).first()[0]
            if not total:
                raise ValueError("targets are negative, or none has mass")
            target[d] = checkpointed(raw.select("label", (F.col("share") / total).alias("share")))
        raked, off = rake_cluster(cells.select(*DIMS, (F.col("mass") / float(stats["mass"])).alias("share")), target, keep)
        factors = raked.select(*DIMS, "factor")
    if off > CLOSE:
        told = f"marginals miss their targets by up to {off:.3g} of a target"
        if strict:
            raise NotMet(told)
        warnings.warn(told, stacklevel=2)
    out = seen.join(factors, list(DIMS), "left").withColumn("factor", F.coalesce("factor", F.lit(0.0)))
    chance = F.least(F.col("factor"), F.lit(1.0))
    uniform = F.conv(F.substring("draw", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    plain = F.when(F.col("topic") == "null", None).otherwise(F.substring("topic", 2, 1 << 30))
    out = out.select(*names, plain.alias("mix_topic"), F.col("tokens").alias("mix_tokens"), F.col("factor").alias("mix_weight"), chance.alias("mix_probability"), (uniform < chance).cast("int").alias("mix_sampled"))
    return out.toDF(*docs.columns, *out.columns[len(names) :])


def _hits(words: list[str]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{f}'" for f in forms(words)) + ")))"


def _wanted(d: str) -> str:
    rule = TARGETS[d]
    if not isinstance(rule, dict):
        return f"SELECT {d}, sum(mass) ** {rule} AS raw FROM cells GROUP BY {d}"
    named = ", ".join(f"('{k}', {v})" for k, v in rule.items() if k != "*")
    return f"""SELECT {d}, coalesce(t, {rule.get("*", 0.0)} * s / sum(s) FILTER (WHERE t IS NULL) OVER ()) AS raw
  FROM (SELECT {d}, sum(mass) AS s FROM cells GROUP BY {d}) LEFT JOIN (VALUES {named}) g(k, t) ON k = {d}"""


_STEP = """SELECT * REPLACE (least(f * CASE WHEN now > 0 THEN want * {keep} / now ELSE 0 END, {largest}) AS f) FROM
    (SELECT *, sum(mass * least(f, 1)) OVER (PARTITION BY {d}) AS now, want_{d} AS want FROM ({inner}))"""


def _round() -> str:
    inner = f"SELECT * FROM raked WHERE it < {ROUNDS}"
    for d in DIMS:
        inner = _STEP.format(keep=KEEP, largest=LARGEST, d=d, inner=inner.replace("SELECT * FROM (", "SELECT * EXCLUDE (now, want) FROM (", 1) if d == DIMS[0] else f"SELECT * EXCLUDE (now, want) FROM ({inner})")
    return inner


#: DuckDB: the same rounds as a recursive query over the cells, all of them, settled or not.
ORACLE = f"""
WITH RECURSIVE cut AS (SELECT doc_id, source, lang, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents),
hits AS (SELECT doc_id, source, lang, len(w)::BIGINT AS tokens, [{", ".join(_hits(s) for s in TOPICS.values())}] AS h FROM cut),
seen AS (
  SELECT doc_id, source, lang, tokens, CASE WHEN list_max(h) > 0 THEN [{", ".join(f"'{t}'" for t in TOPICS)}][list_position(h, list_max(h))] ELSE '{OTHER}' END AS topic FROM hits
), sums AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS m FROM seen GROUP BY ALL HAVING sum(tokens) > 0),
cells AS (SELECT source, lang, topic, m / sum(m) OVER () AS mass FROM sums),
{", ".join(f"raw_{d} AS ({_wanted(d)}), want_{d} AS (SELECT {d}, raw / sum(raw) OVER () AS want_{d} FROM raw_{d})" for d in DIMS)},
raked AS (
  SELECT 0 AS it, c.*, want_source, want_lang, want_topic, {KEEP}::DOUBLE AS f FROM cells c JOIN want_source USING (source) JOIN want_lang USING (lang) JOIN want_topic USING (topic)
  UNION ALL SELECT it + 1, source, lang, topic, mass, want_source, want_lang, want_topic, f FROM ({_round()})
), factors AS (SELECT source, lang, topic, f FROM raked WHERE it = {ROUNDS})
SELECT doc_id, s.source, s.lang, s.topic, tokens, round(coalesce(f, 0), 6) AS weight, round(least(coalesce(f, 0), 1), 6) AS probability,
  CASE WHEN ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / {float(1 << 52)} < least(coalesce(f, 0), 1) THEN 1 ELSE 0 END AS sampled
FROM seen s LEFT JOIN factors c ON s.source = c.source AND s.lang = c.lang AND s.topic = c.topic
"""
