"""A static review page from item and decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.checks import PRIORITY, STATUSES, html_escape, safe_link
from evidentia.operators import ledger as ledgers


def cell(c):
    """Missing and empty values are both blank."""
    return html_escape(F.coalesce(c, F.lit("")))


def evidence_html(e):
    url = e["official_source"]
    source = F.when(safe_link(url), F.concat(F.lit('<a href="'), html_escape(url), F.lit('" rel="noreferrer noopener">'), html_escape(url), F.lit("</a>"))).otherwise(cell(url))
    t = e["version_transition"]
    change = F.when(t.isNull(), "").otherwise(F.concat(F.lit(" &rarr; "), cell(t["effective_from"]), F.lit(" "), cell(t["title"]), F.lit(" "), cell(t["provision"])))
    span = F.concat(cell(e["matched_effective_from"]), F.lit(" &ndash; "), cell(e["matched_effective_to"]))
    return F.concat(F.lit("<li>"), cell(e["record_id"]), F.lit(": "), cell(e["matched_title"]), F.lit(" "), cell(e["matched_provision"]), F.lit(" ("), span, F.lit(")"), change, F.lit(" "), source, F.lit(" "), cell(e["retrieved_at"]), F.lit("</li>"))


def rows_html(items: DataFrame, events: DataFrame) -> DataFrame:
    """(pair, status, place, html): items by priority of status, then number, with the latest decision or ``unreviewed``."""
    latest = ledgers.latest_decisions(events).withColumnRenamed("ledger", "pair")
    joined = items.join(latest, ["pair", "item_number"], "left")
    order = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    cells = [F.col("item_number").cast("string"), F.col("status"), F.col("reason_code"), F.col("locator"), F.col("title"), F.col("provision"), F.coalesce("disposition", F.lit("unreviewed"))]
    evidence = F.concat(F.lit("<td><ul>"), F.array_join(F.transform("evidence", evidence_html), ""), F.lit("</ul></td>"))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), cell(c), F.lit("</td>")) for c in cells), evidence, F.lit("</tr>"))
    return joined.select("pair", "status", F.row_number().over(Window.partitionBy("pair").orderBy(order, "item_number")).alias("place"), row.alias("html"))


#: What a page says above its items.
HEADS = "pair int, document_name string, as_of string, digest string, n_items int, unreviewed_count long, disposition_counts map<string,long>, seconds map<string,double>, errors array<struct<code:string,stage:string,message:string>>"


def listed(c):
    """``key: value`` pairs of a map in the order of its keys; no value is told as unknown."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(cell(x["key"]), F.lit(": "), F.coalesce(x["value"].cast("string"), F.lit("unknown")))), ", ")


def pages(items: DataFrame, events: DataFrame, heads: DataFrame) -> DataFrame:
    """(pair, html) for heads as in HEADS; one page a report, whose items are bounded in number."""
    rows = rows_html(items, events).groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("place", "status", "html"))).alias("rows"))
    of = lambda s: F.size(F.filter("rows", lambda x: x["status"] == s))
    joined = heads.join(rows, "pair", "left").withColumns({s: F.when(F.col("rows").isNotNull(), of(s)) for s in STATUSES})
    summary = F.concat_ws(", ", *(F.concat(F.lit(f"{s}: "), F.coalesce(s, F.lit(0)).cast("string")) for s in PRIORITY))
    errors = F.array_join(F.transform("errors", lambda e: F.concat(F.lit("<li>"), cell(e["code"]), F.lit(" ("), cell(e["stage"]), F.lit("): "), cell(e["message"]), F.lit("</li>"))), "")
    warning = F.when(F.size("errors") > 0, F.concat(F.lit("<h2>Collection errors: the evidence is incomplete</h2><ul>"), errors, F.lit("</ul>"))).otherwise("")
    empty = F.when(F.col("n_items") == 0, "<p>No candidates: this does not mean that the review is complete.</p>").otherwise("")
    name, para = cell(F.col("document_name")), lambda *c: F.concat(F.lit("<p>"), *(F.lit(x) if isinstance(x, str) else x for x in c), F.lit("</p>"))
    top = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Evidence review</title></head><body><h1>Evidence review</h1>'), para(name, ", as of ", cell(F.col("as_of")), ", report digest ", cell(F.col("digest"))), para("Keep this page private: it holds identifiers and evidence as they are. It draws no legal conclusion and vouches for no source."))
    told = F.concat(warning, para("Statuses: ", summary), para("Unreviewed: ", F.col("unreviewed_count").cast("string"), "; decisions: ", listed("disposition_counts")), para("Seconds by stage: ", listed("seconds")), empty)
    head = "<table>\n<tr><th>Item</th><th>Status</th><th>Reason</th><th>Place</th><th>Title</th><th>Provision</th><th>Decision</th><th>Evidence</th></tr>\n"

    def section(status: str):
        own = F.transform(F.filter(F.coalesce("rows", F.array().cast("array<struct<place:int,status:string,html:string>>")), lambda x: x["status"] == status), lambda x: x["html"])
        return F.concat(F.lit(f"<section><h2>{status} ("), F.coalesce(status, F.lit(0)).cast("string"), F.lit(f")</h2>\n{head}"), F.array_join(own, "\n"), F.lit("\n</table></section>\n"))

    return joined.select("pair", F.concat(top, told, *map(section, PRIORITY), F.lit("</body></html>\n")).alias("html"))
