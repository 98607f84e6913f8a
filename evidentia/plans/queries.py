"""One query per operator over the driver tables, with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import checks
from evidentia.operators import binding, compare, extract, ledger, report, resolve
from evidentia.plans import oracles as o
from evidentia.plans import render
from evidentia.plans.registry import query
from evidentia.sources import bulk, catalog, hwpx
from evidentia.streaming import ledgers, stages
from evidentia.workers import checkpointed, shared_folder

AS_OF = "2025-01-01"
COMMON = ["the", "there", "on", "onen", "ing the", "nting"]
LICENCE_FORM = {"provision": "[Vv]ersion [0-9]+(\\.[0-9]+)?", "lookahead": 32, "markers": ["Licensed", "Released", "licensed"]}
WORD_FORM = {"provision": "[a-z]+ing", "lookahead": 12, "markers": ["ed", "tion", "er th"]}

#: A dated licence catalog for the text queries.
LICENCE_VERSIONS = [
    (0, 0, "apache", "https://licences.example.org/apache", "2024-01-01T00:00:00Z", "2004-01-01", "2025-06-01", "Apache License"),
    (0, 1, "apache", "https://licences.example.org/apache", "2024-01-01T00:00:00Z", "2025-06-01", None, "Apache License"),
    (1, 0, "gpl", "https://licences.example.org/gpl", "2024-01-01T00:00:00Z", "1991-06-01", "2007-06-29", "GNU General Public License"),
    (1, 1, "gpl", "https://licences.example.org/gpl", "2024-01-01T00:00:00Z", "2007-06-29", None, "GNU General Public License"),
    (2, 0, "mit", "https://licences.example.org/mit", "2024-01-01T00:00:00Z", "1988-01-01", None, "MIT License"),
    (3, 0, "cc-a", "https://licences.example.org/cc", "2024-01-01T00:00:00Z", "2013-11-25", None, "CC BY-NC"),
    (4, 0, "cc-b", "https://licences.example.org/cc-copy", "2024-01-01T00:00:00Z", "2013-11-25", None, "CC BY-NC"),
    (5, 0, "short", "https://licences.example.org/short", "2024-01-01T00:00:00Z", "2000-01-01", None, "License"),
]
LICENCE_PROVISIONS = [(0, 0, 0, "v", "Version 2.0"), (0, 1, 0, "v", "Version 3.0"), (1, 0, 0, "v", "version 2"), (1, 1, 0, "v", "version 3"), (2, 0, 0, "v", "version 1"), (3, 0, 0, "v", "Version 4.0"), (4, 0, 0, "v", "Version 4.0"), (5, 0, 0, "v", "version 0")]


#: Splits below which texts are dealt anew to all cores; a large table is read as it lies.
FEW_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of long texts, which may be small and yet one split however many cores wait."""
    rows, cores = table(spark, sf_dir, name).select(*columns), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else rows


def licences(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    day = lambda x: None if x is None else date.fromisoformat(x)
    versions = [(*r[:5], day(r[5]), day(r[6]), r[7]) for r in LICENCE_VERSIONS]
    return catalog.local_frame(spark, versions, catalog.VERSIONS), catalog.local_frame(spark, LICENCE_PROVISIONS, catalog.PROVISIONS)


def nodes(spark, sf_dir):
    return extract.lines_as_nodes(texts(spark, sf_dir, "documents", "doc_id", "text"))


def words(spark):
    return spark.createDataFrame([(w,) for w in COMMON], "title string")


def word_mentions(spark, sf_dir, *columns):
    return extract.mentions(nodes(spark, sf_dir), extract.Dictionary.of(COMMON), ["doc_id", "ordinal"], **WORD_FORM, columns=columns)


def licence_candidates(spark, sf_dir):
    titles = extract.Dictionary.of(r[7] for r in LICENCE_VERSIONS)
    return extract.mentions(nodes(spark, sf_dir), titles, ["doc_id", "ordinal"], **LICENCE_FORM, columns=("candidates",))


def licence_items(spark, sf_dir):
    v, p = licences(spark)
    rows = extract.candidates(licence_candidates(spark, sf_dir), "doc_id", ["ordinal"])
    return resolve.attach(rows, v, p, AS_OF)


WITH_WORDS = f"WITH {o.NODES.strip()}, {o.titles_of(COMMON)}, {o.mentions(WORD_FORM['markers'], 12, '[a-z]+ing').strip()} "
WITH_ITEMS = f"WITH {o.LICENCES.strip()}, {o.NODES.strip()}, {o.LICENCE_TITLES}, {o.mentions(LICENCE_FORM['markers'], 32, '[Vv]ersion [0-9]+(?:[.][0-9]+)?').strip()}, {o.RESOLVED.format(as_of=AS_OF).strip()} "


# --- documents and nodes


@query("SELECT doc_id, count(*)::BIGINT AS nodes, sum(len(text))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE text <> '' GROUP BY doc_id")
def text_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {o.NODES.strip()} SELECT doc_id, ordinal, text FROM nodes")
def node_ordinals_skip_empty(spark, sf_dir):
    return nodes(spark, sf_dir)


@query("SELECT doc_id, 'document-' || substr(sha256(text), 1, 12) || '.hwpx' AS document_name FROM documents")
def pseudonym_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.document_name(F.sha2(F.col("text").cast("binary"), 256)).alias("document_name"))


@query("SELECT doc_id, sha256(text) AS document_sha256, sha256(text) = lower(sha256(text)) AND length(sha256(text)) = 64 AS well_formed FROM documents")
def content_sha256(spark, sf_dir):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("document_sha256"), checks.sha256_text(sha).alias("well_formed"))


@query(r"""
WITH names AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Contents/section' || doc_id || '.xml' WHEN 1 THEN 'Contents/section00' || doc_id || '.xml' WHEN 2 THEN 'Contents//section' || doc_id || '.xml' WHEN 3 THEN './Contents/./section' || doc_id || '.xml'
  WHEN 4 THEN 'Contents/section.xml' WHEN 5 THEN 'x/Contents/section' || doc_id || '.xml' WHEN 6 THEN '{' || source || '}' || lang ELSE lang END AS name FROM documents)
SELECT doc_id, nullif(CASE WHEN d = '' THEN '' WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END, '') AS digits, regexp_extract(name, '[^}]*$') AS local_name
FROM (SELECT doc_id, name, regexp_extract(regexp_replace(regexp_replace(name, '/([.]/)+', '/', 'g'), '/+', '/', 'g'), '^(?:[.]/)*Contents/section([0-9]+)[.]xml$', 1) AS d FROM names)""")
def section_names(spark, sf_dir):
    """Names made of ids, sources and languages: those of sections, near ones, and tags with and without a namespace."""
    k, i = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kinds = [text("Contents/section", i, ".xml"), text("Contents/section00", i, ".xml"), text("Contents//section", i, ".xml"), text("./Contents/./section", i, ".xml"), F.lit("Contents/section.xml"), text("x/Contents/section", i, ".xml"), text("{", F.col("source"), "}", F.col("lang"))]
    name = F.col("lang")
    for n, kind in enumerate(kinds):
        name = F.when(k == n, kind).otherwise(name)
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", checks.section_key(F.col("name"))["digits"].alias("digits"), checks.local_name(F.col("name")).alias("local_name"))


@query("SELECT doc_id, contains(upper(text), '<!DOCTYPE') OR contains(upper(text), '<!ENTITY') AS rejected FROM (SELECT page_id AS doc_id, html AS text FROM pages)")
def dtd_rejection(spark, sf_dir):
    text = F.upper("html")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), (text.contains("<!DOCTYPE") | text.contains("<!ENTITY")).alias("rejected"))


# --- extraction


@query(WITH_WORDS + "SELECT doc_id, ordinal, title, count(*)::BIGINT AS hits FROM hits GROUP BY ALL")
def title_candidates_theta_join(spark, sf_dir):
    hit = extract.with_hits(nodes(spark, sf_dir), words(spark), ["doc_id", "ordinal"])
    return hit.select("doc_id", "ordinal", F.explode("hits").alias("h")).groupBy("doc_id", "ordinal", F.col("h.title").alias("title")).agg(F.count("*").alias("hits"))


@query(r"""WITH titles AS (SELECT DISTINCT title FROM (SELECT unnest(string_split(text, ' ')) AS title FROM benchmark) WHERE len(title) >= 6),
""" + o.NODES.strip() + ", hits AS (SELECT doc_id, ordinal, title, (len(text) - len(replace(text, title, ''))) // len(title) AS n FROM nodes JOIN titles ON contains(text, title)) SELECT title, sum(n)::BIGINT AS hits, count(*)::BIGINT AS lines FROM hits GROUP BY title")
def large_dictionary_join(spark, sf_dir):
    """The longer words of the benchmark passages in all lines, none of them held by a worker: windows that pass a bitmap of hashes are joined."""
    titles = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("title")).where(F.length("title") >= 6)
    found = extract.with_hits(nodes(spark, sf_dir), titles, ["doc_id", "ordinal"], held=0)
    each = found.select("doc_id", "ordinal", F.explode("hits.title").alias("title")).groupBy("title", "doc_id", "ordinal").agg(F.count("*").alias("n"))
    return each.groupBy("title").agg(F.sum("n").alias("hits"), F.count("*").alias("lines"))


@query(WITH_WORDS + 'SELECT doc_id, ordinal, start, stop, title FROM flat')
def greedy_longest_title(spark, sf_dir):
    return word_mentions(spark, sf_dir, "selected").select("doc_id", "ordinal", F.explode("selected").alias("s")).select("doc_id", "ordinal", "s.start", F.col("s.end").alias("stop"), "s.title")


@query(WITH_WORDS + "SELECT doc_id, ordinal, start, next::INT AS next_start FROM selected")
def next_title_start(spark, sf_dir):
    return word_mentions(spark, sf_dir, "selected").select("doc_id", "ordinal", F.explode("selected").alias("s")).select("doc_id", "ordinal", "s.start", F.col("s.next").alias("next_start"))


@query(WITH_ITEMS + "SELECT doc_id, ordinal, start, title, provision FROM candidates")
def provision_binding(spark, sf_dir):
    return licence_candidates(spark, sf_dir).select("doc_id", "ordinal", F.explode("candidates").alias("c")).select("doc_id", "ordinal", "c.start", "c.title", "c.provision")


@query(WITH_WORDS + "SELECT doc_id, ordinal, start, title, provision FROM candidates WHERE provision IS NOT NULL")
def provision_truncation(spark, sf_dir):
    return word_mentions(spark, sf_dir, "candidates").select("doc_id", "ordinal", F.explode("candidates").alias("c")).select("doc_id", "ordinal", "c.start", "c.title", "c.provision").where("provision IS NOT NULL")


@query(WITH_WORDS + "SELECT doc_id, ordinal, min(first) AS start FROM uncovered GROUP BY doc_id, ordinal")
def ambiguous_markers(spark, sf_dir):
    return word_mentions(spark, sf_dir, "candidates").select("doc_id", "ordinal", F.explode("candidates").alias("c")).where("c.title IS NULL").select("doc_id", "ordinal", "c.start")


@query(WITH_WORDS + "SELECT doc_id, ordinal, matches FROM examined")
def match_budget(spark, sf_dir):
    return word_mentions(spark, sf_dir, "matches").select("doc_id", "ordinal", "matches")


@query(WITH_WORDS + """, n AS (SELECT doc_id, ordinal, count(*) AS c FROM candidates GROUP BY ALL), m AS (SELECT doc_id, max(matches) AS mn, sum(matches) AS md FROM examined GROUP BY 1),
k AS (SELECT doc_id, max(c) AS cn, sum(c) AS cd FROM n GROUP BY 1)
SELECT c.doc_id, count(*)::BIGINT AS items FROM candidates c JOIN m USING (doc_id) JOIN k USING (doc_id) WHERE mn <= 60 AND md <= 200 AND cn <= 30 AND cd <= 100 GROUP BY 1""")
def candidate_budget_fail_closed(spark, sf_dir):
    """Candidates of the documents within all budgets; nodes meet in their document once, below one shuffle of numbers."""
    found = word_mentions(spark, sf_dir, "candidates", "matches").select("doc_id", "matches", F.size("candidates").alias("n"))
    documents = found.groupBy("doc_id").agg(extract.beyond_budget(lambda c: c, 60, 200, 30, 100, n=F.col("n")).alias("void"), F.sum("n").alias("items"))
    return documents.where("NOT void AND items > 0").select("doc_id", "items")


# --- resolution


@query(WITH_ITEMS + "SELECT doc_id, item_number, title, provision, status, reason_code FROM items")
def resolve_status_lattice(spark, sf_dir):
    return licence_items(spark, sf_dir).select("doc_id", "item_number", "title", "provision", "status", "reason_code")


@query(WITH_ITEMS + "SELECT s.status, count(i.status)::BIGINT AS items FROM (VALUES ('CURRENT'), ('HISTORY'), ('REVIEW'), ('UNKNOWN')) s(status) LEFT JOIN items i ON i.status = s.status GROUP BY 1")
def status_counts(spark, sf_dir):
    n = licence_items(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in checks.STATUSES], "status string")
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("items"))


@query(WITH_ITEMS + "SELECT doc_id, item_number, evidence FROM items")
def evidence_arrays(spark, sf_dir):
    def told(e):
        t = e["version_transition"]
        change = F.when(t.isNull(), "").otherwise(F.concat_ws("/", t["effective_from"], t["title"], t["provision"]))
        return F.concat_ws("|", e["record_id"], e["matched_effective_from"], F.coalesce(e["matched_effective_to"], F.lit("")), F.coalesce(e["matched_provision"], F.lit("")), change)

    return licence_items(spark, sf_dir).select("doc_id", "item_number", F.array_join(F.transform("evidence", told), ";").alias("evidence"))


@query(WITH_ITEMS + """SELECT doc_id, item_number, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['REVIEW', 'UNKNOWN', 'HISTORY', 'CURRENT'], status), item_number)::INT AS place FROM items""")
def review_priority_order(spark, sf_dir):
    order = F.array_position(F.array(*map(F.lit, checks.PRIORITY)), F.col("status"))
    return licence_items(spark, sf_dir).select("doc_id", "item_number", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "item_number")).alias("place"))


SCD = """
days AS (SELECT o_custkey, o_orderdate::DATE AS d, min(o_orderkey) AS k FROM orders GROUP BY ALL),
versions AS (SELECT o_custkey AS record_seq, row_number() OVER w::INT AS version_seq, d AS effective_from, lead(d) OVER w AS effective_to, 'T' || (k % 3) AS title, 'L' || (k % 2) AS label FROM days WINDOW w AS (PARTITION BY o_custkey ORDER BY d))"""


def histories(spark, sf_dir):
    """Order days as version histories of customers, with one provision each."""
    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.min("o_orderkey").alias("k"))
    w = Window.partitionBy("o_custkey").orderBy("d")
    title, label = (F.concat(F.lit(p), (F.col("k") % n).cast("string")) for p, n in (("T", 3), ("L", 2)))
    return days.select(F.col("o_custkey").alias("record_seq"), F.row_number().over(w).alias("version_seq"), F.col("d").alias("effective_from"), F.lead("d").over(w).alias("effective_to"), title.alias("title"), label.alias("label"))


@query(f"""WITH {SCD.strip()} SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS ship_day, v.version_seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN versions v ON v.record_seq = o_custkey AND v.effective_from <= l_shipdate::DATE AND (v.effective_to IS NULL OR l_shipdate::DATE < v.effective_to)""")
def asof_interval_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("ship_day"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("record_seq"))
    hit = resolve.as_of_day(lines.join(owner, "l_orderkey"), histories(spark, sf_dir), "record_seq", "ship_day", ["version_seq"])
    return hit.select("l_orderkey", "l_linenumber", "l_partkey", "ship_day", "version_seq")


@query(f"""WITH {SCD.strip()}, bent AS (SELECT record_seq, version_seq, effective_from, CASE WHEN version_seq % 5 = 0 THEN effective_from WHEN version_seq % 7 = 0 THEN NULL WHEN version_seq % 11 = 0 THEN effective_to + 400 ELSE effective_to END AS effective_to FROM versions),
seen AS (SELECT *, lag(effective_to) OVER w AS pt, row_number() OVER w AS rn, lead(version_seq) OVER w AS nx FROM bent WINDOW w AS (PARTITION BY record_seq ORDER BY version_seq))
SELECT record_seq, version_seq, fault FROM (SELECT record_seq, version_seq, CASE WHEN effective_to IS NOT NULL AND effective_from >= effective_to THEN 'EMPTY_INTERVAL' WHEN rn > 1 AND pt IS NULL THEN 'OPEN_BEFORE_LAST' WHEN rn > 1 AND effective_from < pt THEN 'OVERLAP' WHEN nx IS NULL AND effective_to IS NOT NULL THEN 'CLOSED_LAST' END AS fault FROM seen) WHERE fault IS NOT NULL""")
def version_gap_check(spark, sf_dir):
    s = F.col("version_seq")
    bent = F.when(s % 5 == 0, F.col("effective_from")).when(s % 7 == 0, None).when(s % 11 == 0, F.date_add("effective_to", 400)).otherwise(F.col("effective_to"))
    return resolve.version_faults(histories(spark, sf_dir).withColumn("effective_to", bent))


@query(f"WITH {SCD.strip()} SELECT record_seq, version_seq, title FROM versions v WHERE version_seq = (SELECT max(version_seq) FROM versions x WHERE x.record_seq = v.record_seq)")
def latest_version(spark, sf_dir):
    return resolve.latest_versions(histories(spark, sf_dir)).select("record_seq", "version_seq", "title")


@query(f"""WITH {SCD.strip()}, m AS (SELECT record_seq, max(version_seq) AS version_seq FROM versions GROUP BY 1), n AS (SELECT v.* FROM versions v JOIN m USING (record_seq, version_seq))
SELECT v.record_seq, v.version_seq, n.title = v.title AND n.label = v.label AS unchanged, CASE WHEN NOT (n.title = v.title AND n.label = v.label) THEN n.effective_from::VARCHAR || '/' || n.title || '/' || n.label END AS change
FROM versions v JOIN n ON n.record_seq = v.record_seq""")
def version_transition(spark, sf_dir):
    v = histories(spark, sf_dir)
    p = v.select("record_seq", "version_seq", F.lit(0).alias("provision_seq"), F.lit("c").alias("canonical_id"), "label")
    t = F.col("version_transition")
    return resolve.transitions(v, p).select("record_seq", "version_seq", "unchanged", F.when(t.isNotNull(), F.concat_ws("/", t["effective_from"], t["title"], t["provision"])).alias("change"))


# --- validators


@query(r"""
WITH u AS (SELECT page_id, replace(url, 'http://', CASE WHEN page_id % 3 = 0 THEN 'https://a_b@' ELSE 'https://' END) || CASE page_id % 5 WHEN 0 THEN ' x' WHEN 1 THEN chr(92) ELSE '' END AS url FROM pages),
c AS (SELECT *, regexp_extract(url, '^(?i:https)://([^/?#]*)', 1) AS a FROM u)
SELECT page_id, regexp_matches(url, '^(?i:https)://') AND regexp_matches(a, '^[^:@]+(:[0-9]*)?$') AND NOT regexp_matches(url, '[\s\\[:cntrl:]]') AS valid,
  regexp_matches(url, '^(?i:https)://') AND regexp_matches(a, '^[^:@]+(:[0-9]*)?$') AND NOT regexp_matches(url, '[\s\\[:cntrl:]]') AND NOT regexp_matches(url, '["''<>]') AS linkable FROM c""")
def https_url_valid(spark, sf_dir):
    p, url = F.col("page_id"), F.col("url")
    bent = F.concat(F.when(p % 3 == 0, F.replace(url, F.lit("http://"), F.lit("https://a_b@"))).otherwise(F.replace(url, F.lit("http://"), F.lit("https://"))), F.when(p % 5 == 0, " x").when(p % 5 == 1, "\\").otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", bent.alias("url"))
    return rows.select("page_id", checks.https_url(F.col("url")).alias("valid"), checks.safe_link(F.col("url")).alias("linkable"))


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-31') WHEN 2 THEN '0000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT o_orderkey, regexp_full_match(day, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND day NOT LIKE '0000%' AND try_cast(day AS DATE) IS NOT NULL AS valid FROM d""")
def strict_date_valid(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    day = F.when(k % 6 == 0, F.date_format(d, "yyyyMMdd")).when(k % 6 == 1, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31"))).when(k % 6 == 2, "0000-01-01").otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.strict_date(day).alias("valid"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 7 WHEN 0 THEN 'Z' WHEN 1 THEN '+23:59' WHEN 2 THEN '+24:00' WHEN 3 THEN '' WHEN 4 THEN '.5Z' WHEN 5 THEN '.Z' ELSE '-05:30' END AS t FROM events)
SELECT event_id, event_id % 7 IN (0, 1, 4, 6) AS valid, event_id % 7 IN (0, 4) AS utc FROM t""")
def rfc3339_valid(spark, sf_dir):
    m = F.col("event_id") % 7
    tail = F.when(m == 0, "Z").when(m == 1, "+23:59").when(m == 2, "+24:00").when(m == 3, "").when(m == 4, ".5Z").when(m == 5, ".Z").otherwise("-05:30")
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), tail)
    return table(spark, sf_dir, "events").select("event_id", checks.timestamp_with_offset(t).alias("valid"), checks.utc_timestamp(t).alias("utc"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN substr(sha256(text), 2) ELSE sha256(text) END AS s FROM documents) SELECT doc_id, regexp_full_match(s, '[0-9a-f]{64}') AS valid FROM s""")
def sha_format(spark, sf_dir):
    sha, m = F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").select("doc_id", checks.sha256_text(F.when(m == 0, F.upper(sha)).when(m == 1, F.substring(sha, 2, 64)).otherwise(sha)).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return checks.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(r"WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN chr(9) || chr(10) WHEN 2 THEN '' ELSE text END AS t FROM documents) SELECT doc_id, regexp_matches(t, '\S') AS filled FROM t")
def nonempty_string(spark, sf_dir):
    m = F.col("doc_id") % 5
    t = F.when(m == 0, "  ").when(m == 1, "\t\n").when(m == 2, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", checks.non_empty(t).alias("filled"))


@query("""SELECT user_id, event_id, json_keys(props::JSON) = ['k'] AS exact FROM events""")
def exact_key_object(spark, sf_dir):
    keys = F.array_sort(F.json_object_keys("props"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(keys == F.array(F.lit("k")), F.lit(False)).alias("exact"))


# --- comparison


def item_tables(spark, sf_dir):
    """Order lines as two reports of one document an order, in one frame: both are numbered in one pass, which leaves them dealt by pair."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    kept = F.col("l_partkey") % 17 != 0
    numbered = table(spark, sf_dir, "lineitem").withColumns({"old_number": F.row_number().over(w), "new_number": F.count_if(kept).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")})
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    title, status = text("S", F.col("l_suppkey") % 3), F.col("l_returnflag")
    old = F.struct(F.lit(0).alias("side"), F.col("old_number").alias("item_number"), title.alias("title"), status.alias("status"))
    new = F.struct(F.lit(1).alias("side"), F.col("new_number").alias("item_number"), F.when(F.col("l_partkey") % 19 == 0, "S9").otherwise(title).alias("title"), F.when(F.col("l_suppkey") % 5 == 0, "X").otherwise(status).alias("status"))
    lines = numbered.select(
        F.col("l_orderkey").alias("pair"), text("L", F.col("l_linenumber")).alias("locator"), F.when(F.col("l_partkey") % 4 > 0, text("P", F.col("l_partkey") % 5)).alias("provision"),
        F.col("l_linestatus").alias("reason_code"), F.array((F.col("l_partkey") % 13).cast("string")).alias("evidence"), F.inline(F.when(kept, F.array(old, new)).otherwise(F.array(old))),
    )
    return lines.select("pair", "side", "item_number", "locator", "title", "provision", "status", "reason_code", "evidence")


WITH_COMPARE = f"WITH {o.ITEMS.strip()} "


@query(WITH_COMPARE + "SELECT o.pair, 'status' AS type, o.item_number AS before_item_number, o.item_number AS after_item_number FROM old o JOIN new n USING (pair, item_number) JOIN pos USING (pair, item_number) WHERE o.status <> n.status OR o.reason_code <> n.reason_code")
def compare_status_changes(spark, sf_dir):
    return compare.in_place_changes(item_tables(spark, sf_dir), "status")


EVIDENCE_CHANGES = "SELECT o.pair, 'evidence' AS type, o.item_number AS before_item_number, o.item_number AS after_item_number FROM old o JOIN new n USING (pair, item_number) JOIN pos USING (pair, item_number) WHERE o.l_partkey % 13 <> n.l_partkey % 13"
REMOVED = "SELECT pair, item_number AS before_item_number FROM jo WHERE ns IS NULL AND ids <= 1 AND refs <= 1 AND nids <= 1 AND nrefs <= 1"
ADDED = "SELECT pair, item_number AS after_item_number FROM fr WHERE oids = 0 AND orefs = 0 AND ids <= 1 AND refs <= 1"


@query(WITH_COMPARE + EVIDENCE_CHANGES)
def compare_evidence_changes(spark, sf_dir):
    return compare.in_place_changes(item_tables(spark, sf_dir), "evidence")


@query(WITH_COMPARE + f""", every AS (SELECT pair, 0 AS g, o.item_number AS n, 1 AS k, 'status' AS type FROM old o JOIN new n USING (pair, item_number) JOIN pos USING (pair, item_number) WHERE o.status <> n.status OR o.reason_code <> n.reason_code
UNION ALL SELECT pair, 0, before_item_number, 2, 'evidence' FROM ({EVIDENCE_CHANGES}) UNION ALL SELECT pair, 1, before_item_number, 0, 'removed' FROM ({REMOVED}) UNION ALL SELECT pair, 2, after_item_number, 0, 'added' FROM ({ADDED}))
SELECT pair, type, n AS item_number, row_number() OVER (PARTITION BY pair ORDER BY g, n, k)::INT AS place FROM every""")
def compare_change_order(spark, sf_dir):
    ordered = compare.in_order(compare.changes(item_tables(spark, sf_dir)))
    return ordered.select("pair", "type", F.coalesce("before_item_number", "after_item_number").alias("item_number"), "place")


@query(WITH_COMPARE + REMOVED)
def compare_removed(spark, sf_dir):
    return compare.changes(item_tables(spark, sf_dir)).where("type = 'removed'").select("pair", "before_item_number")


@query(WITH_COMPARE + ADDED)
def compare_added(spark, sf_dir):
    return compare.changes(item_tables(spark, sf_dir)).where("type = 'added'").select("pair", "after_item_number")


@query(WITH_COMPARE + """SELECT pair, CASE WHEN ns IS NULL THEN 'moved_or_ambiguous' ELSE 'candidate_identity_unconfirmed' END AS reason, item_number::VARCHAR AS before_item_numbers, coalesce(ns, '') AS after_item_numbers FROM jo WHERE ns IS NOT NULL OR NOT (ids <= 1 AND refs <= 1 AND nids <= 1 AND nrefs <= 1)
UNION ALL SELECT pair, 'candidate_identity_unconfirmed', '', item_number::VARCHAR FROM fr WHERE NOT (oids = 0 AND orefs = 0 AND ids <= 1 AND refs <= 1)""")
def compare_unresolved(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return compare.findings(item_tables(spark, sf_dir)).where("reason IS NOT NULL").select("pair", "reason", joined("before_item_numbers"), joined("after_item_numbers"))


@query(WITH_COMPARE + """, p AS (SELECT o.pair, o.item_number AS b, n.item_number AS a FROM oc o JOIN nc n ON o.pair = n.pair AND o.locator = n.locator AND o.title = n.title AND o.provision IS NOT DISTINCT FROM n.provision WHERE o.refs = 1 AND n.refs = 1)
SELECT o.pair, CASE WHEN p.a IS NULL THEN 'moved_or_ambiguous' ELSE 'candidate_identity_unconfirmed' END AS reason, o.item_number::VARCHAR AS before_item_numbers, coalesce(p.a::VARCHAR, '') AS after_item_numbers FROM old o LEFT JOIN p ON p.pair = o.pair AND p.b = o.item_number
UNION ALL SELECT n.pair, 'candidate_identity_unconfirmed', '', n.item_number::VARCHAR FROM new n LEFT JOIN p ON p.pair = n.pair AND p.a = n.item_number WHERE p.a IS NULL""")
def compare_related_versions(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return compare.related_versions(item_tables(spark, sf_dir)).select("pair", "reason", joined("before_item_numbers"), joined("after_item_numbers"))


@query(WITH_COMPARE + "SELECT pair, item_number, ids::BIGINT AS identities, refs::BIGINT AS \"references\" FROM oc")
def multiset_identity_counts(spark, sf_dir):
    return compare.counted(item_tables(spark, sf_dir).where("side = 0")).select("pair", "item_number", "identities", "references")


@query("""SELECT o_custkey AS pair, CASE WHEN min(o_orderkey) % 5 = 0 THEN 'collection_errors' WHEN count(*) < 6 THEN 'empty_report_not_completion' WHEN o_custkey % 3 = 0 THEN 'unrelated_documents' END AS reason,
NOT (min(o_orderkey) % 5 = 0 OR count(*) < 6 OR o_custkey % 3 = 0) AS comparable, CASE WHEN o_custkey % 3 = 0 THEN 'unavailable' ELSE 'same_document' END AS relationship, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 2 = 0 THEN '' ELSE 'catalog' END AS metadata FROM orders GROUP BY o_custkey""")
def compare_gates(spark, sf_dir):
    k = F.col("pair")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pair")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k"))
    head = lambda doc, cat, items, errors: n.select("pair", doc.alias("document_sha256"), cat.alias("catalog_sha256"), F.lit(AS_OF).alias("as_of"), items.alias("n_items"), errors.alias("n_errors"))
    before = head(F.lit("a"), F.lit("c"), F.lit(3), F.lit(0))
    after = head(F.when(k % 3 == 0, "b").otherwise("a"), F.when(k % 2 == 0, "c").otherwise("d"), F.when(F.col("n") < 6, 0).otherwise(2), F.when(F.col("k") % 5 == 0, 1).otherwise(0))
    return compare.headers(before, after).select("pair", "reason", "comparable", "relationship", F.array_join("metadata", ",").alias("metadata"))


@query("""WITH h AS (SELECT o_custkey AS pair, CASE WHEN o_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS doc, CASE WHEN o_custkey % 2 = 0 THEN 'c' ELSE 'd' END AS cat, max(o_orderdate::DATE)::VARCHAR AS day FROM orders GROUP BY o_custkey),
c AS (SELECT pair, 'catalog' AS type, 'c' AS before, cat AS after FROM h WHERE doc = 'a' UNION ALL SELECT pair, 'as_of', '1998-01-01', day FROM h WHERE doc = 'a')
SELECT pair, type, before, after, row_number() OVER (PARTITION BY pair ORDER BY CASE type WHEN 'catalog' THEN 0 ELSE 1 END)::INT AS place FROM c WHERE before <> after""")
def compare_metadata_changes(spark, sf_dir):
    """Customers as pairs of reports, the later one as of their last order: which catalog and day differ, with both values, in order."""
    k = F.col("pair")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pair")).agg(F.max(F.to_date("o_orderdate")).cast("string").alias("day"))
    head = lambda doc, cat, day: n.select("pair", doc.alias("document_sha256"), cat.alias("catalog_sha256"), day.alias("as_of"), F.lit(1).alias("n_items"), F.lit(0).alias("n_errors"))
    found = compare.metadata_changes(head(F.lit("a"), F.lit("c"), F.lit("1998-01-01")), head(F.when(k % 3 == 0, "b").otherwise("a"), F.when(k % 2 == 0, "c").otherwise("d"), F.col("day")))
    numbered = found.withColumns({"before_item_number": F.lit(None).cast("int"), "after_item_number": F.lit(None).cast("int")})
    return compare.in_order(numbered).select("pair", "type", "before", "after", "place")


# --- ledgers


def ledger_events(spark, sf_dir):
    """The event stream as ledgers, one a user, without digests."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase', 'click')")
    action = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "finish").otherwise("decide")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    rows = e.select(F.col("user_id").alias("ledger"), "event_id", action.alias("action"), k.alias("k"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("at"))
    decide = F.col("action") == "decide"
    return rows.select(
        "ledger", F.row_number().over(Window.partitionBy("ledger").orderBy("event_id")).alias("sequence"), "action", F.when(decide, F.col("k") % 10 + 1).alias("item_number"),
        F.when(decide, pick(checks.DISPOSITIONS, F.col("k") % 4)).alias("disposition"), F.when(~decide, pick(checks.STAGES, F.col("k") % 3)).alias("stage"), "at",
    )


def ledger_heads(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger")).distinct().withColumn("n_items", F.lit(10))


WITH_LEDGER = f"WITH {o.LEDGERS.strip()} "
LATEST = "SELECT ledger, item_number, arg_max(disposition, sequence) AS disposition FROM events0 WHERE action = 'decide' GROUP BY ALL"


@query(WITH_LEDGER + LATEST)
def ledger_latest_decision(spark, sf_dir):
    return ledger.latest_decisions(ledger_events(spark, sf_dir))


@query(WITH_LEDGER + f", d AS ({LATEST}) SELECT e.ledger, " + ", ".join(f"count(*) FILTER (WHERE disposition = '{d}')::BIGINT AS \"{d}\"" for d in checks.DISPOSITIONS) + " FROM (SELECT DISTINCT ledger FROM events0) e LEFT JOIN d ON d.ledger = e.ledger GROUP BY 1")
def disposition_counts(spark, sf_dir):
    return ledger.disposition_counts(ledger_events(spark, sf_dir))


@query(WITH_LEDGER + f", d AS ({LATEST}) SELECT h.ledger, (10 - count(d.item_number))::BIGINT AS unreviewed_count FROM heads h LEFT JOIN d ON d.ledger = h.ledger GROUP BY 1")
def unreviewed_count(spark, sf_dir):
    return ledger.unreviewed(ledger_events(spark, sf_dir), ledger_heads(spark, sf_dir)).select("ledger", F.col("unreviewed_count").cast("long"))


EVENT_SQL = """'{"action":"' || action || '","at":"' || "at" || '","disposition":' || coalesce('"' || disposition || '"', 'null') || ',"item_number":' || coalesce(item_number::VARCHAR, 'null') || ',"previous_event_digest":' || 'null' || ',"sequence":' || sequence || ',"stage":' || coalesce('"' || stage || '"', 'null') || '}'"""


CHAINED_SQL = EVENT_SQL.replace(""""previous_event_digest":' || 'null'""", """"previous_event_digest":"' || prev || '"'""")


@query(WITH_LEDGER + f"SELECT ledger, sequence, sha256({EVENT_SQL}) AS digest FROM events0")
def ledger_event_digest(spark, sf_dir):
    e = ledger_events(spark, sf_dir).withColumn("previous_event_digest", F.lit(None).cast("string"))
    return e.select("ledger", "sequence", ledger.event_digest().alias("digest"))


@query(
    WITH_LEDGER
    + f""", first AS (SELECT *, sha256({EVENT_SQL}) AS d FROM events0),
linked AS (SELECT *, lag(d) OVER (PARTITION BY ledger ORDER BY sequence) AS p FROM first)
SELECT ledger, count(*)::BIGINT AS events, bool_and(sequence <= 1 AND NOT (ledger % 3 = 0 AND sequence = 1)) AS valid FROM linked GROUP BY 1"""
)
def ledger_hash_chain_link(spark, sf_dir):
    """All events of every ledger, where later ones carry digests of the wrong text: a ledger of one event stands, if that is not bent."""
    e = ledger_events(spark, sf_dir).withColumn("previous_event_digest", F.lit(None).cast("string"))
    e = e.withColumn("digest", ledger.event_digest())
    linked = e.withColumn("previous_event_digest", F.lag("digest").over(Window.partitionBy("ledger").orderBy("sequence")))
    bent = linked.withColumn("digest", F.when((F.col("ledger") % 3 == 0) & (F.col("sequence") == 1), F.reverse("digest")).otherwise(F.col("digest")))
    return ledger.validate(bent, 10)


@query(
    WITH_LEDGER.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", chain AS (SELECT *, NULL::VARCHAR AS prev, sha256({EVENT_SQL}) AS d FROM events0 WHERE sequence = 1
  UNION ALL SELECT * REPLACE (sha256({CHAINED_SQL}) AS d) FROM (SELECT e.*, c.d AS prev, '' AS d FROM chain c JOIN events0 e ON e.ledger = c.ledger AND e.sequence = c.sequence + 1)),
counted AS (SELECT *, count(*) OVER (PARTITION BY ledger) AS n FROM chain),
relinked AS (SELECT * REPLACE (CASE WHEN ledger % 4 = 2 AND sequence = n THEN reverse(prev) ELSE prev END AS prev) FROM counted),
hashed AS (SELECT *, CASE WHEN prev IS NULL THEN sha256({EVENT_SQL}) ELSE sha256({CHAINED_SQL}) END AS own FROM relinked),
bent AS (SELECT *, CASE WHEN ledger % 4 = 0 AND sequence = n OR ledger % 4 = 1 AND sequence = n // 2 + 1 THEN reverse(own) ELSE own END AS digest FROM hashed),
checked AS (SELECT ledger, digest = own AND prev IS NOT DISTINCT FROM lag(digest) OVER (PARTITION BY ledger ORDER BY sequence) AS ok FROM bent)
SELECT ledger, count(*)::BIGINT AS events, bool_and(ok) AS valid FROM checked GROUP BY 1"""
)
def ledger_chain_whole(spark, sf_dir):
    """All events of every ledger chained, then of four ledgers one with a bent last digest, one with a bent digest in the
    middle, one whose last event is hashed over a wrong link, and one that stands."""
    e = ledger.chain(ledger_events(spark, sf_dir))
    k, s = F.col("ledger") % 4, F.col("sequence")
    n = F.count("*").over(Window.partitionBy("ledger"))
    relinked = e.withColumn("n", n).withColumn("previous_event_digest", F.when((k == 2) & (s == F.col("n")), F.reverse("previous_event_digest")).otherwise(F.col("previous_event_digest")))
    wrong = ((k == 0) & (s == F.col("n"))) | ((k == 1) & (s == F.floor(F.col("n") / 2) + 1))
    own = F.when((k == 2) & (s == F.col("n")), ledger.event_digest()).otherwise(F.col("digest"))
    return ledger.validate(relinked.withColumn("digest", F.when(wrong, F.reverse("digest")).otherwise(own)), 10)


STEPS = """, t AS (SELECT ledger, stage, sequence, action, epoch_us(replace("at", 'Z', '')::TIMESTAMP) AS us FROM events0 WHERE action <> 'decide'),
u AS (SELECT *, lag(action) OVER w AS prev, lag(us) OVER w AS pus, lead(action) OVER w IS NULL AS is_last FROM t WINDOW w AS (PARTITION BY ledger, stage ORDER BY sequence)),
steps AS (SELECT ledger, stage, sequence, action, coalesce(CASE WHEN action = 'start' THEN prev = 'start' ELSE coalesce(prev, '') <> 'start' OR us < pus END, false) AS bad, is_last AND action = 'start' AS open,
  CASE WHEN action = 'finish' AND prev = 'start' AND us >= pus THEN pus END AS start_us, CASE WHEN action = 'finish' AND prev = 'start' AND us >= pus THEN us END AS end_us FROM u),
iv AS (SELECT ledger, stage, start_us, end_us, row_number() OVER (PARTITION BY ledger ORDER BY start_us, end_us, stage) AS rn FROM steps WHERE end_us IS NOT NULL),
ov AS (
  SELECT DISTINCT ledger, unnest([stage, bs]) AS stage FROM (
    SELECT a.ledger, a.stage, a.start_us, (SELECT b.stage FROM iv b WHERE b.ledger = a.ledger AND b.rn < a.rn ORDER BY b.end_us DESC, b.rn LIMIT 1) AS bs, (SELECT max(b.end_us) FROM iv b WHERE b.ledger = a.ledger AND b.rn < a.rn) AS be FROM iv a) WHERE start_us < be)"""


@query(WITH_LEDGER + STEPS + " SELECT ledger, stage, sequence, bad, open, (end_us - start_us)::BIGINT AS us FROM steps")
def stage_state_machine(spark, sf_dir):
    return ledger.stage_steps(ledger_events(spark, sf_dir)).select("ledger", "stage", "sequence", "bad", "open", (F.col("end_us") - F.col("start_us")).alias("us"))


@query(WITH_LEDGER + STEPS + " SELECT ledger, stage FROM ov")
def stage_overlap(spark, sf_dir):
    return ledger.overlapping(ledger.stage_steps(ledger_events(spark, sf_dir)))


@query(WITH_LEDGER + STEPS + """, per AS (SELECT ledger, stage, bool_or(bad) AS bad, bool_or(open) AS open, count(end_us) AS n, sum(end_us - start_us)::BIGINT AS us FROM steps GROUP BY ALL)
SELECT p.ledger, p.stage, CASE WHEN bad OR open OR n = 0 OR o.stage IS NOT NULL THEN 'unknown' ELSE 'measured' END AS status, CASE WHEN NOT (bad OR open OR n = 0 OR o.stage IS NOT NULL) THEN us END AS us FROM per p LEFT JOIN ov o USING (ledger, stage)""")
def measured_seconds(spark, sf_dir):
    return ledger.timings(ledger_events(spark, sf_dir)).select("ledger", "stage", "status", F.round(F.col("seconds") * 1e6).cast("long").alias("us"))


TIMED = """, per AS (SELECT ledger, stage, bool_or(bad) AS bad, bool_or(open) AS open, count(end_us) AS n, sum(end_us - start_us)::BIGINT AS us FROM steps GROUP BY ALL),
timed AS (SELECT p.ledger, p.stage, bad OR open OR n = 0 OR o.stage IS NOT NULL AS unknown, us FROM per p LEFT JOIN ov o USING (ledger, stage)),
told AS (SELECT h.ledger, string_agg(s.stage || '=' || CASE WHEN coalesce(unknown, true) THEN 'unknown' ELSE 'measured ' || us END, ',' ORDER BY s.stage) AS timing
  FROM heads h CROSS JOIN (VALUES ('triage'), ('evidence'), ('decision')) s(stage) LEFT JOIN timed t ON t.ledger = h.ledger AND t.stage = s.stage GROUP BY 1),
decided AS (SELECT ledger, string_agg(item_number || '=' || disposition, ',' ORDER BY item_number::VARCHAR) AS latest, count(*) AS n,
  'confirm=' || count_if(disposition = 'confirm') || ',defer=' || count_if(disposition = 'defer') || ',investigate=' || count_if(disposition = 'investigate') || ',reject=' || count_if(disposition = 'reject') AS counts
  FROM (SELECT ledger, item_number, arg_max(disposition, sequence) AS disposition FROM events0 WHERE action = 'decide' GROUP BY ALL) GROUP BY 1)"""


@query(WITH_LEDGER + STEPS + TIMED + """ SELECT h.ledger, coalesce(latest, '') AS latest_decisions, (10 - coalesce(n, 0))::BIGINT AS unreviewed_count,
coalesce(counts, 'confirm=0,defer=0,investigate=0,reject=0') AS disposition_counts, timing FROM heads h LEFT JOIN decided d USING (ledger) JOIN told USING (ledger)""")
def ledger_summaries(spark, sf_dir):
    """The whole summary of every ledger, those without events too: decisions, counts and the timing of each stage."""
    out = ledger.summary(ledger_events(spark, sf_dir), ledger_heads(spark, sf_dir))
    pairs = lambda c, value: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), value(x["value"]))), ",")
    spent = lambda v: F.when(v["status"] == "unknown", "unknown").otherwise(F.concat(F.lit("measured "), F.round(v["seconds"] * 1e6).cast("long").cast("string")))
    return out.select("ledger", pairs("latest_decisions", lambda v: v).alias("latest_decisions"), F.col("unreviewed_count").cast("long").alias("unreviewed_count"), pairs("disposition_counts", lambda v: v.cast("string")).alias("disposition_counts"), pairs("timing", spent).alias("timing"))


def streamed(spark, events, work):
    """Runs what ``work`` makes of these events as a stream, to its end, in the shared folder; its rows."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    events.write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    query = work(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    WITH_LEDGER.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", chain AS (SELECT *, NULL::VARCHAR AS prev, sha256({EVENT_SQL}) AS d FROM events0 WHERE sequence = 1
  UNION ALL SELECT * REPLACE (sha256({CHAINED_SQL}) AS d) FROM (SELECT e.*, c.d AS prev, '' AS d FROM chain c JOIN events0 e ON e.ledger = c.ledger AND e.sequence = c.sequence + 1))
SELECT ledger::VARCHAR AS ledger, sequence, prev AS previous_event_digest, d AS digest FROM chain"""
)
def ledger_stream(spark, sf_dir):
    """All events as a stream that chains them, its state being the last digest of each ledger."""
    out = streamed(spark, ledger_events(spark, sf_dir), ledgers.chained)
    return out.where("error_code IS NULL").select("ledger", "sequence", "previous_event_digest", "digest")


@query(WITH_LEDGER + STEPS + """, per AS (SELECT ledger, stage, bool_or(bad) AS bad, bool_or(open) AS open, count(end_us) AS n, sum(end_us - start_us)::BIGINT AS us FROM steps GROUP BY ALL)
SELECT p.ledger::VARCHAR AS ledger, p.stage, CASE WHEN bad OR open OR n = 0 OR o.stage IS NOT NULL THEN 'unknown' ELSE 'measured' END AS status, CASE WHEN NOT (bad OR open OR n = 0 OR o.stage IS NOT NULL) THEN us END AS us FROM per p LEFT JOIN ov o USING (ledger, stage)""")
def stage_stream(spark, sf_dir):
    """All events as a stream that measures the stages of each ledger."""
    arrived = ledger_events(spark, sf_dir).withColumn("arrived", F.to_timestamp("at"))
    out = streamed(spark, arrived, lambda s: stages.stage_times(s, "arrived", delay_seconds=3600, patience_seconds=10**9))
    return out.where("kind IN ('measured', 'unknown')").select("ledger", "stage", F.col("kind").alias("status"), "us")


# --- rendering


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", checks.html_escape(F.col("html")).alias("escaped"))


ROW_SQL = "'<tr><td>' || item_number || '</td><td>' || status || '</td><td>' || reason_code || '</td><td>' || 'n' || ordinal || '</td><td>' || coalesce(title, '') || '</td><td>' || coalesce(provision, '') || '</td><td>unreviewed</td><td><ul></ul></td></tr>'"


@query(WITH_ITEMS + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['REVIEW', 'UNKNOWN', 'HISTORY', 'CURRENT'], status), item_number)::INT AS place, {ROW_SQL} AS html FROM items")
def review_rows_html(spark, sf_dir):
    items = licence_items(spark, sf_dir).select(F.col("doc_id").alias("pair"), "item_number", F.concat(F.lit("n"), F.col("ordinal").cast("string")).alias("locator"), "title", "provision", "status", "reason_code", F.array().cast(resolve.EVIDENCE).alias("evidence"))
    none = spark.createDataFrame([], "ledger long, sequence int, action string, item_number int, disposition string")
    return render.rows_html(items, none).select(F.col("pair").alias("doc_id"), "place", "html")


PAGE_TOP = '<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Evidence review</title></head><body><h1>Evidence review</h1><p>'
PAGE_PRIVATE = "<p>Keep this page private: it holds identifiers and evidence as they are. It draws no legal conclusion and vouches for no source.</p>"
PAGE_HEAD = "<table>\n<tr><th>Item</th><th>Status</th><th>Reason</th><th>Place</th><th>Title</th><th>Provision</th><th>Decision</th><th>Evidence</th></tr>\n"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _section_sql(status: str) -> str:
    rows = f"coalesce(string_agg(row, chr(10) ORDER BY item_number) FILTER (WHERE status = '{status}'), '')"
    return f"'<section><h2>{status} (' || count(*) FILTER (WHERE status = '{status}') || ')</h2>' || chr(10) || {_sql_text(PAGE_HEAD)} || {rows} || chr(10) || '</table></section>' || chr(10)"


@query(WITH_ITEMS + f""", drawn AS (SELECT doc_id, item_number, status, {ROW_SQL} AS row FROM items),
grouped AS (SELECT doc_id, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in checks.PRIORITY)}, {" || ".join(map(_section_sql, checks.PRIORITY))} AS sections FROM drawn GROUP BY doc_id)
SELECT d.doc_id, {_sql_text(PAGE_TOP)} || 'document-' || substr(sha256(d.text), 1, 12) || '.hwpx, as of 2025-01-01, report digest ' || sha256(d.text) || '</p>' || {_sql_text(PAGE_PRIVATE)}
  || CASE WHEN d.doc_id % 3 = 0 THEN '<h2>Collection errors: the evidence is incomplete</h2><ul><li>A&amp;B (parse): &lt;none&gt;</li></ul>' ELSE '' END
  || '<p>Statuses: ' || {" || ', ' || ".join(f"'{x}: ' || coalesce({x}, 0)" for x in checks.PRIORITY)} || '</p><p>Unreviewed: ' || coalesce(n, 0) || '; decisions: confirm: 0, reject: 0</p><p>Seconds by stage: triage: unknown</p>'
  || CASE WHEN n IS NULL THEN '<p>No candidates: this does not mean that the review is complete.</p>' ELSE '' END
  || coalesce(sections, {" || ".join(f"'<section><h2>{x} (0)</h2>' || chr(10) || {_sql_text(PAGE_HEAD)} || chr(10) || '</table></section>' || chr(10)" for x in checks.PRIORITY)}) || '</body></html>' || chr(10) AS html
FROM documents d LEFT JOIN grouped g USING (doc_id)""")
def review_pages(spark, sf_dir):
    """The whole page of every document, those without items and those with an error too."""
    items = licence_items(spark, sf_dir).select(F.col("doc_id").alias("pair"), "item_number", F.concat(F.lit("n"), F.col("ordinal").cast("string")).alias("locator"), "title", "provision", "status", "reason_code", F.array().cast(resolve.EVIDENCE).alias("evidence"))
    none = spark.createDataFrame([], "ledger long, sequence int, action string, item_number int, disposition string")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    fault = F.array(F.struct(F.lit("A&B").alias("code"), F.lit("parse").alias("stage"), F.lit("<none>").alias("message")))
    n = items.groupBy("pair").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair"), sha.alias("digest"), checks.document_name(sha).alias("document_name"), F.when(F.col("doc_id") % 3 == 0, fault).otherwise(F.array().cast("array<struct<code:string,stage:string,message:string>>")).alias("errors"))
    zero = F.create_map(F.lit("confirm"), F.lit(0).cast("long"), F.lit("reject"), F.lit(0).cast("long"))
    heads = docs.join(n, "pair", "left").select("pair", "document_name", F.lit(AS_OF).alias("as_of"), "digest", F.coalesce("n", F.lit(0)).cast("int").alias("n_items"), F.coalesce("n", F.lit(0)).alias("unreviewed_count"), zero.alias("disposition_counts"), F.create_map(F.lit("triage"), F.lit(None).cast("double")).alias("seconds"), "errors")
    return render.pages(items, none, heads).select(F.col("pair").alias("doc_id"), "html")


# --- reports and documents


@query(WITH_ITEMS + "SELECT doc_id, item_number, json_object('locator', 'n' || ordinal, 'reference', json_object('title', title, 'provision', provision), 'status', status, 'reason_code', reason_code, 'evidence', json_array())::VARCHAR AS json FROM items")
def report_item_json(spark, sf_dir):
    rows = licence_items(spark, sf_dir).withColumns({"locator": F.concat(F.lit("n"), F.col("ordinal").cast("string")), "evidence": F.array().cast(resolve.EVIDENCE)})
    return rows.select("doc_id", "item_number", F.to_json(report.item(), {"ignoreNullFields": "false"}).alias("json"))


@query(WITH_ITEMS + "SELECT d.doc_id, sha256(d.text) AS document_sha256, count(i.doc_id) FILTER (WHERE d.doc_id % 3 <> 0)::BIGINT AS items, CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS errors FROM documents d LEFT JOIN items i ON i.doc_id = d.doc_id GROUP BY d.doc_id, d.text")
def reports_fail_closed(spark, sf_dir):
    """Documents of which a third have an error: those have it and no items, whatever was found."""
    docs = table(spark, sf_dir, "documents")
    documents = docs.select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("document_sha256"))
    items = licence_items(spark, sf_dir).withColumnRenamed("doc_id", "path").withColumn("locator", F.col("ordinal").cast("string"))
    errors = documents.where("path % 3 = 0").select("path", F.lit("HWPX_XML_INVALID").alias("code"), F.lit("parse").alias("stage"), F.lit(None).cast("string").alias("locator"), F.lit("m").alias("message"))
    made = report.reports(documents, items, errors, AS_OF, "c" * 64)
    return made.select(F.col("path").alias("doc_id"), "document_sha256", F.size("items").cast("long").alias("items"), F.size("collection_errors").alias("errors"))


@query("SELECT doc_id::VARCHAR AS path, ordinal, 'Contents/section0.xml:t[' || ordinal || ']' AS locator, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS ordinal FROM documents) WHERE text <> ''")
def hwpx_nodes(spark, sf_dir):
    """Every document written as an archive of one section, a text element a line, and parsed again."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines"))
    return hwpx.parse_documents(hwpx.as_archives(docs)).where("text IS NOT NULL").select("path", "ordinal", "locator", "text")


#: How the archives of ``archives_refused`` are bent, by the id modulo 10, and what becomes of them; the rest stand.
BENT_ARCHIVES = {1: "DOCUMENT_NOT_ZIP", 2: "HWPX_MIMETYPE_INVALID", 3: "HWPX_SECTION_MISSING", 4: "HWPX_XML_INVALID", 5: "HWPX_XML_INVALID", 6: "HWPX_XML_INVALID", 7: "HWPX_XML_INVALID", 8: "DOCUMENT_NOT_ZIP", 9: "HWPX_MIMETYPE_INVALID"}


@query(f"""WITH n AS (SELECT doc_id, count(*) AS nodes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE t <> '' GROUP BY doc_id),
e AS (SELECT doc_id, CASE doc_id % 10 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in BENT_ARCHIVES.items())} END AS error_code FROM documents)
SELECT doc_id::VARCHAR AS path, error_code, CASE WHEN error_code IS NULL THEN coalesce(nodes, 0) ELSE 0 END::BIGINT AS nodes FROM e LEFT JOIN n USING (doc_id)""")
def archives_refused(spark, sf_dir):
    """Every document as an archive, nine of ten of them bent: no archive, a wrong or missing type, no section, a document type
    declaration, open or misplaced tags, another encoding, two sections of one number, a cut file."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines"), (F.col("doc_id") % 10).cast("int").alias("bend"))
    read = hwpx.parse_documents(hwpx.bent_archives(docs))
    return read.groupBy("path").agg(F.max("error_code").alias("error_code"), F.count("text").alias("nodes"))


@query(WITH_LEDGER + f""", d AS (SELECT ledger, max(sequence) AS n, arg_max(sha256({EVENT_SQL}), sequence) AS prev FROM events0 GROUP BY ledger),
e AS (SELECT ledger, n + 1 AS sequence, prev, 'finish' AS action, '2030-01-01T00:00:00Z' AS "at", NULL AS disposition, NULL::INT AS item_number, 'triage' AS stage FROM d)
SELECT ledger, sequence::INT AS sequence, prev AS previous_event_digest, sha256({CHAINED_SQL}) AS digest FROM e""")
def ledger_append(spark, sf_dir):
    events = ledger_events(spark, sf_dir).withColumn("previous_event_digest", F.lit(None).cast("string"))
    events = events.withColumn("digest", ledger.event_digest())
    new = events.select("ledger").distinct().select("ledger", F.lit("finish").alias("action"), F.lit(None).cast("int").alias("item_number"), F.lit(None).cast("string").alias("disposition"), F.lit("triage").alias("stage"), F.lit("2030-01-01T00:00:00Z").alias("at"))
    return ledger.append(events, new).where("at = '2030-01-01T00:00:00Z'").select("ledger", "sequence", "previous_event_digest", "digest")


@query(WITH_LEDGER + """, b AS (SELECT ledger, sequence, action, CASE WHEN sequence % 5 = 0 THEN 11 ELSE item_number END AS item_number, disposition, CASE WHEN sequence % 7 = 0 THEN 'triage' ELSE stage END AS stage FROM events0)
SELECT ledger, sequence, CASE WHEN action = 'decide' THEN item_number BETWEEN 1 AND 10 AND stage IS NULL ELSE item_number IS NULL AND stage IS NOT NULL END AS coherent FROM b""")
def event_coherence(spark, sf_dir):
    s = F.col("sequence")
    bent = ledger_events(spark, sf_dir).withColumns({"item_number": F.when(s % 5 == 0, 11).otherwise(F.col("item_number")), "stage": F.when(s % 7 == 0, "triage").otherwise(F.col("stage"))})
    return bent.select("ledger", "sequence", ledger.coherent(F.lit(10)).alias("coherent"))


# --- many catalogs, reports and ledgers


def source_catalogs(spark, sf_dir):
    """A catalog a source of the documents, as the JSON text that a file of it would hold; of each five, two are refused."""
    sources = table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct()
    record = lambda w: F.when(F.substring(F.md5(F.concat("source", F.lit(w)).cast("binary")), 1, 1) < "8", F.lit('{"record_id":"%s","official_source":{"url":"https://c.example.org/","retrieved_at":"2024-01-01T00:00:00Z"},"versions":[{"effective_from":"2000-01-01","effective_to":null,"title":"%s","provisions":[{"canonical_id":"p","label":"thing"}]}]}' % (w, w)))
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 5
    text = F.concat(F.lit('{"schema_version":"'), F.when(k == 0, "2").otherwise("1"), F.lit('","records":['), F.array_join(F.array_compact(F.array(*map(record, COMMON))), ","), F.when(k == 1, "],}").otherwise("]}"))
    return sources.select(F.col("source").alias("path"), text.cast("binary").alias("content"))


RECORD_SQL = ", ".join("CASE WHEN substr(md5(source || '%s'), 1, 1) < '8' THEN '{\"record_id\":\"%s\",\"official_source\":{\"url\":\"https://c.example.org/\",\"retrieved_at\":\"2024-01-01T00:00:00Z\"},\"versions\":[{\"effective_from\":\"2000-01-01\",\"effective_to\":null,\"title\":\"%s\",\"provisions\":[{\"canonical_id\":\"p\",\"label\":\"thing\"}]}]}' END" % (w, w, w) for w in COMMON)
MANY = f"""
sources AS (SELECT DISTINCT source, regexp_extract(source, '[0-9]+')::INT % 5 AS k FROM documents WHERE source IS NOT NULL),
texts AS (SELECT source, k, [{", ".join(f"'{w}'" for w in COMMON)}] AS w, [{RECORD_SQL}] AS r FROM sources),
catalogs AS (
  SELECT source, list_filter(r, lambda x: x IS NOT NULL) AS kept, list_filter(w, lambda x: substr(md5(source || x), 1, 1) < '8') AS titles,
    CASE WHEN k = 0 THEN 'CATALOG_SCHEMA_UNSUPPORTED' WHEN k = 1 THEN 'CATALOG_JSON_INVALID' WHEN len(list_filter(r, lambda x: x IS NOT NULL)) = 0 THEN 'CATALOG_SCHEMA_INVALID' END AS error_code FROM texts)"""


@query(f"""WITH {MANY.strip()} SELECT source, error_code, CASE WHEN error_code IS NULL THEN len(kept) END::INT AS versions,
CASE WHEN error_code IS NULL THEN sha256('{{"schema_version":"1","records":[' || array_to_string(kept, ',') || ']}}') END AS catalog_sha256 FROM catalogs""")
def catalogs_bulk(spark, sf_dir):
    """The catalogs of all sources, validated on the cluster; two of five are refused."""
    read = bulk.catalogs(source_catalogs(spark, sf_dir))
    return read.select(F.col("path").alias("source"), "error_code", F.when(F.col("error_code").isNull(), F.size("versions")).alias("versions"), "catalog_sha256")


@query(f"""WITH {MANY.strip()}, {o.NODES.strip()},
titles AS (SELECT DISTINCT d.doc_id, unnest(titles) AS title FROM documents d JOIN catalogs c USING (source) WHERE error_code IS NULL),
{o.mentions(WORD_FORM["markers"], 12, "[a-z]+ing").strip().replace("nodes JOIN titles ON contains(text, title)", "nodes JOIN titles USING (doc_id) WHERE contains(text, title)")}
SELECT doc_id, ordinal, start, title, CASE WHEN title IS NULL THEN 'UNKNOWN' WHEN provision = 'thing' THEN 'CURRENT' ELSE 'REVIEW' END AS status,
  CASE WHEN title IS NULL THEN 'AMBIGUOUS_CITATION' WHEN provision = 'thing' THEN 'EXACT_CURRENT_MATCH' ELSE 'PROVISION_MISMATCH' END AS reason_code FROM candidates""")
def catalogs_many(spark, sf_dir):
    """Every line of every document against the catalog of its own source, found and resolved in one plan."""
    kept = checkpointed(bulk.accepted(bulk.catalogs(source_catalogs(spark, sf_dir))))  # parsed once, asked for often
    v, p = bulk.versions(kept, "source"), bulk.provisions(kept, "source")
    docs = texts(spark, sf_dir, "documents", "doc_id", "source", "text")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "text")).where("text <> ''").withColumn("ordinal", F.col("at") + 1)
    found = extract.catalog_mentions(lines, v, ["doc_id", "ordinal"], "source", **WORD_FORM, columns=("candidates",))
    rows = found.select("doc_id", "source", "ordinal", F.explode("candidates").alias("c")).select("doc_id", "source", "ordinal", "c.start", "c.title", "c.provision")
    return resolve.attach(rows, v, p, AS_OF, by=("source",)).select("doc_id", "ordinal", "start", "title", "status", "reason_code")


#: How the reports of ``document_reports`` are bent: by the id modulo 20, 1 to 10; the rest stand.
BENT_JSON, BENT_REPORT = (1, 2, 3, 4, 8, 9, 10), (5, 6, 7)
ITEM_JSON = '{"locator":"n1","reference":{"title":null,"provision":null},"status":"UNKNOWN","reason_code":"AMBIGUOUS_CITATION","evidence":[]}'
ITEM_CANONICAL = '{"evidence":[],"locator":"n1","reason_code":"AMBIGUOUS_CITATION","reference":{"provision":null,"title":null},"status":"UNKNOWN"}'


def document_reports(spark, sf_dir):
    """(doc_id, path, content, report_digest, document_sha256): a report file a document, half of them bent, and the digest of the report meant."""
    sha, k = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), F.col("doc_id") % 20
    rows = table(spark, sf_dir, "documents").select("doc_id", k.cast("int").alias("k"), (F.col("doc_id") % 4).cast("int").alias("n"), sha.alias("document_sha256"))
    name = F.concat(F.lit("document-"), F.substring("document_sha256", 1, 12), F.lit(".hwpx"))
    listed = lambda item: F.array_join(F.array_repeat(F.lit(item), F.col("n")), ",")
    k = F.col("k")
    text = F.concat(
        F.when(k == 8, "\ufeff").when(k == 9, "[").otherwise(""), F.lit("{"), F.when(k == 7, "").otherwise('"schema_version":"1",'), F.when(k == 5, '"more":1,').otherwise(""), F.when(k == 1, '"items":[],').otherwise(""),
        F.lit('"document_name":"'), F.when(k == 4, "\\ud800").otherwise(""), name, F.lit('","document_sha256":"'), F.col("document_sha256"), F.lit('","as_of":'), F.when(k == 2, "NaN").when(k == 6, '"20250101"').otherwise('"2025-01-01"'),
        F.lit(',"catalog_sha256":"' + "c" * 64 + '","items":['), listed(ITEM_JSON), F.lit('],"collection_errors":'), F.when(k == 3, "[" * 40 + "]" * 40).otherwise("[]"), F.lit("}"), F.when(k == 9, "]").otherwise(""),
    )
    meant = F.concat(F.lit('{"as_of":"2025-01-01","catalog_sha256":"' + "c" * 64 + '","collection_errors":[],"document_name":"'), name, F.lit('","document_sha256":"'), F.col("document_sha256"), F.lit('","items":['), listed(ITEM_CANONICAL), F.lit('],"schema_version":"1"}'))
    content = F.when(k == 10, F.concat(text.cast("binary"), F.unhex(F.lit("FF")))).otherwise(text.cast("binary"))
    return rows.select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"), F.sha2(meant.cast("binary"), 256).alias("report_digest"), "document_sha256")


MEANT = f"""
r AS (SELECT doc_id, doc_id % 20 AS k, doc_id % 4 AS n, sha256(coalesce(text, '')) AS sha FROM documents),
meant AS (SELECT *, CASE WHEN k IN {BENT_JSON} THEN 'REVIEW_JSON_INVALID' WHEN k IN {BENT_REPORT} THEN 'REVIEW_REPORT_INVALID' END AS report_error,
  sha256('{{"as_of":"2025-01-01","catalog_sha256":"{"c" * 64}","collection_errors":[],"document_name":"document-' || substr(sha, 1, 12) || '.hwpx","document_sha256":"' || sha || '","items":[' || array_to_string(list_transform(range(n), lambda i: '{ITEM_CANONICAL}'), ',') || '],"schema_version":"1"}}') AS digest FROM r)"""


@query(f"""WITH {MEANT.strip()} SELECT 'r' || doc_id AS path, report_error AS error_code, CASE WHEN report_error IS NULL THEN n END::INT AS items,
CASE WHEN report_error IS NULL THEN digest END AS report_digest, CASE WHEN report_error IS NULL THEN digest END AS column_digest FROM meant""")
def reports_bulk(spark, sf_dir):
    """A report file a document read on the cluster: repeated keys, NaN, depth, lone surrogates, byte order marks, bytes that are no text,
    unknown and missing keys and bad days are refused; the digest of the bytes' value and that of the typed columns are the same."""
    read = bulk.reports(document_reports(spark, sf_dir))
    good = F.col("error_code").isNull()
    return read.select("path", "error_code", F.when(good, F.size("items")).alias("items"), "report_digest", F.when(good, binding.report_digest()).alias("column_digest"))


def document_ledgers(spark, sf_dir):
    """(path, content): a ledger file a document, of one event; some name another day, some have a wrong digest."""
    event = '{"action":"decide","at":"2025-02-01T00:00:00Z","disposition":"confirm","item_number":1,"previous_event_digest":null,"sequence":1,"stage":null}'
    k = F.col("doc_id")
    digest = F.sha2(F.lit(event).cast("binary"), 256)
    text = F.concat(
        F.lit('{"schema":"citation-review/1","report_digest":"'), F.col("report_digest"), F.lit('","document_sha256":"'), F.col("document_sha256"), F.lit('","catalog_sha256":"' + "c" * 64 + '","as_of":"'), F.when(k % 7 == 0, "2025-01-02").otherwise("2025-01-01"),
        F.lit('","events":[' + event[:-1] + ',"digest":"'), F.when(k % 11 == 0, F.reverse(digest)).otherwise(digest), F.lit('"}]}'),
    )
    return document_reports(spark, sf_dir).select(F.concat(F.lit("l"), k.cast("string")).alias("path"), text.cast("binary").alias("content"))


@query(f"""WITH {MEANT.strip()}, known AS (SELECT digest, min('r' || doc_id) AS report_path FROM meant WHERE report_error IS NULL GROUP BY digest),
fit AS (SELECT m.*, k.report_path, m.doc_id % 7 <> 0 AND m.doc_id % 11 <> 0 AND k.report_path IS NOT NULL AND n >= 1 AS ok FROM meant m LEFT JOIN known k USING (digest))
SELECT 'l' || doc_id AS path, CASE WHEN ok THEN report_path END AS report_path, CASE WHEN ok THEN n END::INT AS n_items, CASE WHEN ok THEN 1 END::INT AS events, CASE WHEN NOT ok THEN 'REVIEW_LEDGER_INVALID' END AS error_code FROM fit""")
def ledgers_bound(spark, sf_dir):
    """Every ledger file with the report it belongs to, or its refusal."""
    bound = binding.bind(bulk.ledgers(document_ledgers(spark, sf_dir)), bulk.reports(document_reports(spark, sf_dir)))
    return bound.select("path", "report_path", "n_items", F.when(F.col("error_code").isNull(), F.size("events")).alias("events"), "error_code")
