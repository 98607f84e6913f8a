"""Resolve (title, provision) against a dated catalog as of a review date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.checks import effective

#: Rows of a key from which an as-of lookup cuts its days into ranges.
HOT_ROWS = 200_000
EVIDENCE = "array<struct<record_id:string,official_source:string,retrieved_at:string,as_of:string,matched_effective_from:string,matched_effective_to:string,matched_title:string,matched_provision:string,version_transition:struct<effective_from:string,title:string,provision:string>>>"


def latest_versions(versions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The last version of each record by its place in the record, whatever its dates."""
    return versions.withColumn("last", F.max("version_seq").over(Window.partitionBy(*by, "record_seq"))).where("version_seq = last").drop("last")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def transitions(versions: DataFrame, provisions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per provision of a version: whether the last version has its canonical id, whether unchanged, and the transition.

    The transition is null where the last version lacks the id or has the same title and label.  ``by`` names what tells the
    catalogs of a table of many apart, here and below.
    """
    last = latest_versions(versions, by).select(*by, "record_seq", F.col("version_seq").alias("last_seq"), F.col("effective_from").alias("last_from"), F.col("title").alias("last_title"))
    labels = provisions.select(*by, "record_seq", F.col("version_seq").alias("last_seq"), "canonical_id", F.col("label").alias("last_label"))
    now = last.join(labels, [*by, "record_seq", "last_seq"])
    joined = provisions.join(versions.select(*by, "record_seq", "version_seq", "title"), [*by, "record_seq", "version_seq"]).join(now.drop("last_seq"), [*by, "record_seq", "canonical_id"], "left")
    same = (F.col("last_title") == F.col("title")) & (F.col("last_label") == F.col("label"))
    change = F.when(F.col("last_title").isNotNull() & ~same, F.struct(iso(F.col("last_from")).alias("effective_from"), F.col("last_title").alias("title"), F.col("last_label").alias("provision")))
    return joined.select(*by, "record_seq", "version_seq", "provision_seq", "label", F.col("last_title").isNull().alias("ended"), F.coalesce(same, F.lit(False)).alias("unchanged"), change.alias("version_transition"))


def resolve(references: DataFrame, versions: DataFrame, provisions: DataFrame, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., title, provision, status, reason_code, evidence) of the distinct references.

    Equal references have equal answers, so only distinct ones are joined; callers join back null-safely.  The catalog sides
    are left to the planner, which broadcasts them while they are small.
    """
    day = F.lit(as_of).cast("date")
    pairs = references.select(*by, "title", "provision").distinct()
    known = pairs.where("title IS NOT NULL")
    v = versions.withColumn("eff", effective(day, F.col("effective_from"), F.col("effective_to")))
    p = transitions(versions, provisions, by).withColumn("label_hit", F.lit(True))
    hits = known.join(v, [*by, "title"]).join(p.withColumnRenamed("label", "provision"), [*by, "record_seq", "version_seq", "provision"], "left").withColumn("label_hit", F.coalesce("label_hit", F.lit(False)))

    def proof(provision: Column, change: Column) -> Column:
        return F.struct(
            "record_seq", "version_seq", F.coalesce("provision_seq", F.lit(-1)).alias("provision_seq"),
            F.struct(F.col("record_id"), F.col("official_source"), F.col("retrieved_at"), F.lit(as_of).alias("as_of"), iso(F.col("effective_from")).alias("matched_effective_from"), iso(F.col("effective_to")).alias("matched_effective_to"), F.col("title").alias("matched_title"), provision.alias("matched_provision"), change.alias("version_transition")).alias("e"),
        )

    none, no_change = F.lit(None).cast("string"), F.lit(None).cast("struct<effective_from:string,title:string,provision:string>")
    labelled = proof(F.when(F.col("label_hit"), F.col("provision")), F.when(F.col("label_hit"), F.col("version_transition")))
    gather = lambda cond, what: F.sort_array(F.collect_list(F.when(cond, what)))
    counted = hits.groupBy(*by, "title", "provision").agg(
        F.count_if(F.col("eff")).alias("tm"),
        F.count_if(F.col("eff") & F.col("label_hit")).alias("ex"),
        F.count_if(F.col("label_hit")).alias("hi"),
        F.bool_or(F.col("eff") & F.col("label_hit") & F.col("ended")).alias("ended"),
        F.bool_or(F.col("eff") & F.col("label_hit") & F.col("unchanged")).alias("unchanged"),
        gather(F.col("eff"), labelled).alias("by_title"),
        gather(F.col("eff") & F.col("label_hit"), labelled).alias("exact"),
        gather(F.col("eff"), proof(none, no_change)).alias("bare"),
        gather(F.col("label_hit"), labelled).alias("ever"),
    )
    keys = [*by, "title", "provision"]
    counted = counted.withColumnsRenamed({k: f"found_{k}" for k in keys})
    answer = pairs.join(counted, [F.col(k).eqNullSafe(F.col(f"found_{k}")) for k in keys], "left").drop(*(f"found_{k}" for k in keys))
    tm, ex, hi = (F.coalesce(c, F.lit(0)) for c in ("tm", "ex", "hi"))
    rules = [
        (F.col("title").isNull(), "UNKNOWN", "AMBIGUOUS_CITATION", None),
        (tm > 1, "REVIEW", "CONFLICTING_EVIDENCE", "by_title"),
        ((ex == 1) & F.col("ended"), "REVIEW", "CONFLICTING_EVIDENCE", "exact"),
        ((ex == 1) & F.col("unchanged"), "CURRENT", "EXACT_CURRENT_MATCH", "exact"),
        (ex == 1, "HISTORY", "EXACT_HISTORICAL_MATCH", "exact"),
        (tm == 1, "REVIEW", "PROVISION_MISMATCH", "bare"),
        (hi > 0, "REVIEW", "CONFLICTING_EVIDENCE", "ever"),
        (F.lit(True), "UNKNOWN", "CATALOG_NO_MATCH", None),
    ]

    def lattice(pick):
        out = None
        for cond, *answers in rules:
            value = pick(answers)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    proofs = lattice(lambda a: F.transform(a[2], lambda x: x["e"]).cast(EVIDENCE) if a[2] else F.array().cast(EVIDENCE))
    return answer.select(*keys, lattice(lambda a: F.lit(a[0])).alias("status"), lattice(lambda a: F.lit(a[1])).alias("reason_code"), proofs.alias("evidence"))


def catalog_answers(versions: DataFrame, provisions: DataFrame, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Answers for every reference that the catalog can tell apart: each title with each label of its versions, and with none."""
    record = [*by, "record_seq", "version_seq"]
    labels = versions.select(*record, "title").join(provisions.select(*record, "label"), record)
    references = labels.select(*by, "title", F.col("label").alias("provision")).unionByName(versions.select(*by, "title", F.lit(None).cast("string").alias("provision")))
    return resolve(references, versions, provisions, as_of, by)


def attach(candidates: DataFrame, versions: DataFrame, provisions: DataFrame, as_of: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with their status, reason and evidence.

    A provision that is no label of its title is answered like no provision, so answers are as many as the catalog has titles and
    labels; the candidates are read once, and joined with what the planner broadcasts while the catalog is small.
    """
    answers = catalog_answers(versions, provisions, as_of, by).select(*by, "title", "provision", F.struct("status", "reason_code", "evidence").alias("answer"))
    exact = answers.where("provision IS NOT NULL").withColumnRenamed("answer", "exact")
    bare = answers.where("provision IS NULL").select(*by, "title", F.col("answer").alias("bare"))
    joined = candidates.join(exact, [*by, "title", "provision"], "left").join(bare, [*by, "title"], "left")
    unnamed = F.when(F.col("title").isNull(), "AMBIGUOUS_CITATION").otherwise("CATALOG_NO_MATCH")
    told = F.coalesce("exact", "bare", F.struct(F.lit("UNKNOWN").alias("status"), unnamed.alias("reason_code"), F.array().cast(EVIDENCE).alias("evidence")))
    return joined.select(*candidates.columns, told.alias("told")).select(*candidates.columns, "told.*")


def hot_ranges(rows: DataFrame, key: str, day: str) -> DataFrame | None:
    """(key, cuts array<date>) of the keys with over HOT_ROWS rows, at most 4 a shuffle partition; None where there are none.

    The cuts part a key's rows into ranges of days of like size.  A key that is not listed has fewer rows than a quarter of an
    average partition, or than HOT_ROWS.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(n).collect()
    if not hot:
        return None
    each = max(HOT_ROWS, sum(r["n"] for r in hot) // n)
    parts = {r[key]: -(-r["n"] // each) for r in hot}
    most = max(parts.values())
    named = rows.sparkSession.createDataFrame([(k,) for k in parts], T.StructType([T.StructField(key, rows.schema[key].dataType)]))
    kept = rows.join(F.broadcast(named), key, "left_semi").groupBy(key).agg(F.percentile_approx(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")), [i / most for i in range(1, most)] or [0.5], 10_000).alias("at"))
    return kept.select(key, F.transform(F.filter("at", lambda d: d.isNotNull()), lambda d: F.date_add(F.lit("1970-01-01").cast("date"), d)).alias("cuts"))


def as_of_day(rows: DataFrame, versions: DataFrame, key: str, day: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of the version of their key that is in force on their day; rows without one are left out.

    Versions of a key must not overlap (``version_faults`` tells).  Rows and versions are merged: in one frame, sorted by key and
    day, each row takes the last version before it, so it meets one version however many there are.  The days of a hot key are
    cut into ranges of like many rows, to each of which the versions in force in it are dealt, that at its beginning included;
    a day that alone fills several ranges is spread over them by a hash.
    """
    cuts = hot_ranges(rows, key, day)
    told = F.struct("effective_from", "effective_to", *columns)
    mine = rows.select(F.col(key).alias("k"), F.col(day).alias("d"), F.struct(*rows.columns).alias("row"))
    theirs = versions.select(F.col(key).alias("k"), F.col("effective_from").alias("d"), told.alias("v"))
    piece = F.lit(0)
    if cuts is not None:
        ranges = F.broadcast(cuts.select(F.col(key).alias("k"), "cuts"))  # at most 4 rows a shuffle partition
        before = lambda day, also: F.coalesce(F.size(F.filter("cuts", lambda c: (c <= day) if also else (c < day))), F.lit(0))
        first, last = before(F.col("d"), False), before(F.col("d"), True)
        spread = F.pmod(F.xxhash64("row"), (last - first + 1).cast("long")).cast("int")
        mine = mine.join(ranges, "k", "left").select("k", "d", "row", F.when(F.col("cuts").isNull(), 0).otherwise(first + spread).alias("piece"))
        upto = F.when(F.col("v.effective_to").isNull(), F.size("cuts")).otherwise(before(F.col("v.effective_to"), False))
        theirs = theirs.join(ranges, "k", "left").select("k", "d", "v", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, F.greatest(first, upto)))).alias("piece"))
    else:
        mine, theirs = mine.withColumn("piece", piece), theirs.withColumn("piece", piece)
    both = mine.withColumn("v", F.lit(None).cast(theirs.schema["v"].dataType)).unionByName(theirs.withColumn("row", F.lit(None).cast(mine.schema["row"].dataType)))
    order = Window.partitionBy("k", "piece").orderBy("d", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.where("k IS NOT NULL AND d IS NOT NULL").withColumn("v", F.last("v", ignorenulls=True).over(order))
    force = F.col("row").isNotNull() & F.col("v").isNotNull() & effective(F.col("d"), F.col("v.effective_from"), F.col("v.effective_to"))
    return merged.where(force).select("row.*", *(F.col(f"v.{c}").alias(c) for c in columns))


def version_faults(versions: DataFrame) -> DataFrame:
    """Versions that break the order of their record: empty interval, start before the last end, open before the last, closed last."""
    w = Window.partitionBy("record_seq").orderBy("version_seq")
    seen = versions.withColumns({"prev_to": F.lag("effective_to").over(w), "first": F.row_number().over(w) == 1, "next_seq": F.lead("version_seq").over(w)})
    fault = (
        F.when(F.col("effective_to").isNotNull() & (F.col("effective_from") >= F.col("effective_to")), "EMPTY_INTERVAL")
        .when(~F.col("first") & F.col("prev_to").isNull(), "OPEN_BEFORE_LAST")
        .when(~F.col("first") & (F.col("effective_from") < F.col("prev_to")), "OVERLAP")
        .when(F.col("next_seq").isNull() & F.col("effective_to").isNotNull(), "CLOSED_LAST")
    )
    return seen.select("record_seq", "version_seq", fault.alias("fault")).where("fault IS NOT NULL")
