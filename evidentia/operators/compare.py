"""Compare evidence reports of one document, or of related versions, conservatively.

Inputs are item tables (pair, item_number, locator, title, provision, status, reason_code, evidence), numbered from 1 within a
pair of reports; many pairs are compared at once.  Nulls in locator, title and provision equal each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Why an item is left unresolved, with and without possible partners.
UNCONFIRMED, MOVED = "candidate_identity_unconfirmed", "moved_or_ambiguous"
IDENTITY, REFERENCE = ["locator", "title", "provision"], ["title", "provision"]


def counted(items: DataFrame) -> DataFrame:
    """Items with the number of items in their report that have the same identity, and the same reference."""
    return items.withColumns({"identities": F.count("*").over(Window.partitionBy("pair", *IDENTITY)), "references": F.count("*").over(Window.partitionBy("pair", *REFERENCE))})


def united(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both reports in one frame, dealt by pair: ``side`` is 0 for old and 1 for new.

    A report has a bounded number of items, so a pair is no hot key.
    """
    return old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).repartition("pair")


def placed(both: DataFrame) -> DataFrame:
    """Items of both sides, sorted once by reference, locator, place and side.

    ``matched`` tells items that stand at the same number with the same identity on the other side, ``after`` is that item's
    status, reason and evidence (for old items).
    """
    w = Window.partitionBy("pair", *REFERENCE).orderBy("locator", "item_number", "side")
    spot = ["locator", "item_number", "side"]
    told = both.withColumns({"next": F.lead(F.struct(*spot, "status", "reason_code", "evidence")).over(w), "last": F.lag(F.struct(*spot)).over(w)})
    met = lambda x: (F.col("side") != x["side"]) & (F.col("item_number") == x["item_number"]) & F.col("locator").eqNullSafe(x["locator"])
    here, there = (F.coalesce(met(F.col(c)), F.lit(False)) for c in ("next", "last"))
    return told.withColumns({"after": F.when(here, F.struct(*(F.col("next")[c].alias(c) for c in ("status", "reason_code", "evidence")))), "matched": here | there}).drop("next", "last")


def judged(both: DataFrame) -> DataFrame:
    """``placed`` with what a reference holds on either side; both windows share one shuffle and one sort.

    ``lone`` is true where the reference does not repeat, and so no identity of it; ``partners`` are the unmatched new items of the reference, ``n_partners`` their
    number; ``first`` is the first unmatched old item of the reference.
    """
    w = Window.partitionBy("pair", *REFERENCE)
    count = lambda side: F.count_if(F.col("side") == side).over(w)
    free = lambda side: F.when((F.col("side") == side) & ~F.col("matched"), F.col("item_number"))
    told = placed(both).withColumns({"n_old": count(0), "n_new": count(1), "first": F.min(free(0)).over(w), "partners": F.collect_list(free(1)).over(w), "n_partners": F.count(free(1)).over(w)})
    return told.withColumn("lone", (F.col("n_old") <= 1) & (F.col("n_new") <= 1))


def kinds() -> Column:
    """The types of change of an old item that is matched in place."""
    a = F.col("after")
    return F.array_compact(F.array(F.when((F.col("status") != a["status"]) | (F.col("reason_code") != a["reason_code"]), "status"), F.when(~F.col("evidence").eqNullSafe(a["evidence"]), "evidence")))


#: Unmatched items of ``judged``: old ones that claim partners, gone ones, and new ones that none claims.
CLAIMS = "side = 0 AND NOT matched AND n_partners > 0 AND item_number = first"
REMOVED = f"side = 0 AND NOT matched AND NOT ({CLAIMS}) AND lone"
LEFT = "side = 1 AND NOT matched AND first IS NULL"
ADDED = f"{LEFT} AND lone AND n_old = 0"


def findings(both: DataFrame) -> DataFrame:
    """(pair, type, reason, before_item_numbers, after_item_numbers): all that two reports of one document differ in, in one pass.

    ``both`` is as ``united`` makes it.  Items matched in place have a row of type ``status`` (status or reason) and one of type
    ``evidence`` where these changed.  An unmatched old item's partners are the unmatched new items of its reference, all claimed
    by the first such old item; without partners it is ``removed`` where nothing repeats, else unresolved.  New items that none
    claims are ``added`` where nothing repeats and the old report knows no such item, else unresolved.  Unresolved rows have a
    reason instead of a type.
    """
    empty, me = F.array().cast("array<int>"), F.array("item_number")
    changed = F.when(F.col("after").isNotNull(), kinds()).when(F.expr(REMOVED), F.array(F.lit("removed"))).when(F.expr(ADDED), F.array(F.lit("added")))
    reason = F.when(F.expr(f"{CLAIMS} OR {LEFT}"), UNCONFIRMED).when(F.expr("side = 0 AND NOT matched"), MOVED)
    types = F.coalesce(changed, F.when(reason.isNotNull(), F.array(F.lit(None).cast("string"))))
    told = judged(both).withColumns({"types": types, "reason": reason}).where("size(types) > 0")
    each = told.withColumn("type", F.explode("types"))
    after = F.when(F.expr(CLAIMS), F.array_sort("partners")).when((F.col("side") == 1) | F.col("after").isNotNull(), me).otherwise(empty)
    return each.select("pair", "type", F.when(F.col("type").isNull(), F.col("reason")).alias("reason"), F.when(F.col("side") == 0, me).otherwise(empty).alias("before_item_numbers"), after.alias("after_item_numbers"))


def changes(both: DataFrame) -> DataFrame:
    """(pair, type, before_item_number, after_item_number): the findings that are changes."""
    types = F.when(F.col("after").isNotNull(), kinds()).when(F.expr(REMOVED), F.array(F.lit("removed"))).when(F.expr(ADDED), F.array(F.lit("added")))
    told = judged(both).withColumn("types", types).where("size(types) > 0")
    return told.select("pair", F.explode("types").alias("type"), F.when(F.col("side") == 0, F.col("item_number")).alias("before_item_number"), F.when((F.col("side") == 1) | F.col("after").isNotNull(), F.col("item_number")).alias("after_item_number"))


def in_place_changes(both: DataFrame, *types: str) -> DataFrame:
    """The changes of the asked types (status, evidence) alone; nothing is counted for them.

    Items that stand at the same number are neighbours in the order of the numbers, so only numbers are sorted, and only what the
    asked types compare is carried on.
    """
    w = Window.partitionBy("pair").orderBy("item_number", "side")
    agrees = lambda c: F.col(c).eqNullSafe(F.col(f"next_{c}"))
    changed = {"status": (F.col("status") != F.col("next_status")) | (F.col("reason_code") != F.col("next_reason_code")), "evidence": ~agrees("evidence")}
    wanted = [F.when(differ, F.lit(name)) for name, differ in changed.items() if name in types]
    compared = [*IDENTITY, *(["status", "reason_code"] if "status" in types else []), *(["evidence"] if "evidence" in types else [])]
    told = both.select("pair", "side", "item_number", *compared).withColumns({f"next_{c}": F.lead(c).over(w) for c in ("side", "item_number", *compared)})
    facing = (F.col("side") == 0) & (F.col("next_side") == 1) & (F.col("item_number") == F.col("next_item_number"))
    each = told.where(facing & agrees("locator") & agrees("title") & agrees("provision")).withColumn("types", F.array_compact(F.array(*wanted))).where("size(types) > 0")
    return each.select("pair", F.explode("types").alias("type"), F.col("item_number").alias("before_item_number"), F.col("item_number").alias("after_item_number"))


def same_document(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, unresolved) of two reports of one document.

    changes: (pair, type, before_item_number, after_item_number); unresolved: (pair, reason, before_item_numbers,
    after_item_numbers).
    """
    both = united(old, new)
    return changes(both), findings(both).where("reason IS NOT NULL").drop("type")


def metadata_changes(before: DataFrame, after: DataFrame, related: bool = False) -> DataFrame:
    """(pair, type, before, after): the ``catalog`` and ``as_of`` values that differ, of heads as for ``headers``, where the documents are related."""
    told = headers(before, after, related).select("pair", F.explode("metadata").alias("type"))
    value = lambda heads, name: heads.select("pair", F.create_map(F.lit("catalog"), "catalog_sha256", F.lit("as_of"), "as_of").alias(name))
    joined = told.join(value(before, "b"), "pair").join(value(after, "a"), "pair")
    return joined.select("pair", "type", F.col("b")[F.col("type")].alias("before"), F.col("a")[F.col("type")].alias("after"))


def in_order(changes: DataFrame) -> DataFrame:
    """Changes with their ``place`` in the pair: in place by number, status before evidence, then removed, then added ones, then metadata."""
    kind = F.array_position(F.array(*map(F.lit, ["status", "evidence", "catalog", "as_of"])), F.col("type"))
    group = F.when(F.col("type").isin("status", "evidence"), 0).when(F.col("type") == "removed", 1).when(F.col("type") == "added", 2).otherwise(3)
    w = Window.partitionBy("pair").orderBy(group, F.coalesce("before_item_number", "after_item_number"), kind)
    return changes.withColumn("place", F.row_number().over(w))


def related_versions(both: DataFrame) -> DataFrame:
    """(pair, reason, before_item_numbers, after_item_numbers): every item of both sides, paired where its identity and unique reference agree."""
    numbers = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("item_number", "locator")))
    g = both.groupBy("pair", *REFERENCE).agg(numbers(0).alias("olds"), numbers(1).alias("news"))
    alone = (F.size("olds") == 1) & (F.size("news") == 1) & F.get("olds", 0)["locator"].eqNullSafe(F.get("news", 0)["locator"])
    empty = F.array().cast("array<int>")
    row = lambda reason, b, a: F.struct(F.lit(reason).alias("reason"), b.alias("before_item_numbers"), a.alias("after_item_numbers"))
    met = F.array(row(UNCONFIRMED, F.array(F.get("olds", 0)["item_number"]), F.array(F.get("news", 0)["item_number"])))
    apart = F.concat(F.transform("olds", lambda x: row(MOVED, F.array(x["item_number"]), empty)), F.transform("news", lambda x: row(UNCONFIRMED, empty, F.array(x["item_number"]))))
    return g.select("pair", F.inline(F.when(alone, met).otherwise(apart)))


def headers(before: DataFrame, after: DataFrame, related: bool = False) -> DataFrame:
    """One row a pair from report heads (pair, document_sha256, catalog_sha256, as_of, n_items, n_errors).

    Gates in order: any collection error, an empty side, unrelated documents; otherwise comparable.  ``metadata`` lists the
    catalog and as_of changes of comparable or merely gated related pairs; decisions never transfer.
    """
    j = before.alias("b").join(after.alias("a"), "pair")
    relation = F.when(F.col("b.document_sha256") == F.col("a.document_sha256"), "same_document").otherwise(F.lit("related_versions" if related else "unavailable"))
    gate = F.when((F.col("b.n_errors") > 0) | (F.col("a.n_errors") > 0), "collection_errors").when((F.col("b.n_items") == 0) | (F.col("a.n_items") == 0), "empty_report_not_completion").when(relation == "unavailable", "unrelated_documents")
    changed = F.array_compact(F.array(F.when(F.col("b.catalog_sha256") != F.col("a.catalog_sha256"), "catalog"), F.when(F.col("b.as_of") != F.col("a.as_of"), "as_of")))
    return j.select("pair", gate.isNull().alias("comparable"), relation.alias("relationship"), gate.alias("reason"), F.when(relation != "unavailable", changed).otherwise(F.array().cast("array<string>")).alias("metadata"), F.lit(False).alias("decision_transfer"))
