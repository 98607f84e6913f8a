"""DuckDB texts that the queries' counterparts are composed of."""

from __future__ import annotations

#: Fixed values of the licence catalog that the text queries scan for: see plans/queries.py.
LICENCES = """
versions(record_seq, version_seq, record_id, official_source, retrieved_at, effective_from, effective_to, title) AS (VALUES
  (0, 0, 'apache', 'https://licences.example.org/apache', '2024-01-01T00:00:00Z', DATE '2004-01-01', DATE '2025-06-01', 'Apache License'),
  (0, 1, 'apache', 'https://licences.example.org/apache', '2024-01-01T00:00:00Z', DATE '2025-06-01', NULL, 'Apache License'),
  (1, 0, 'gpl', 'https://licences.example.org/gpl', '2024-01-01T00:00:00Z', DATE '1991-06-01', DATE '2007-06-29', 'GNU General Public License'),
  (1, 1, 'gpl', 'https://licences.example.org/gpl', '2024-01-01T00:00:00Z', DATE '2007-06-29', NULL, 'GNU General Public License'),
  (2, 0, 'mit', 'https://licences.example.org/mit', '2024-01-01T00:00:00Z', DATE '1988-01-01', NULL, 'MIT License'),
  (3, 0, 'cc-a', 'https://licences.example.org/cc', '2024-01-01T00:00:00Z', DATE '2013-11-25', NULL, 'CC BY-NC'),
  (4, 0, 'cc-b', 'https://licences.example.org/cc-copy', '2024-01-01T00:00:00Z', DATE '2013-11-25', NULL, 'CC BY-NC'),
  (5, 0, 'short', 'https://licences.example.org/short', '2024-01-01T00:00:00Z', DATE '2000-01-01', NULL, 'License')),
provisions(record_seq, version_seq, provision_seq, canonical_id, label) AS (VALUES
  (0, 0, 0, 'v', 'Version 2.0'), (0, 1, 0, 'v', 'Version 3.0'), (1, 0, 0, 'v', 'version 2'), (1, 1, 0, 'v', 'version 3'),
  (2, 0, 0, 'v', 'version 1'), (3, 0, 0, 'v', 'Version 4.0'), (4, 0, 0, 'v', 'Version 4.0'), (5, 0, 0, 'v', 'version 0'))"""

NODES = """
cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
nodes AS (SELECT doc_id, ordinal, text FROM (SELECT doc_id, unnest(parts) AS text, unnest(range(1, len(parts) + 1))::INT AS ordinal FROM cut) WHERE text <> '')"""


def titles_of(words: list[str]) -> str:
    return "titles(title) AS (VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


LICENCE_TITLES = "titles AS (SELECT DISTINCT title FROM versions)"


def starts(text: str, word: str) -> str:
    """Starts of the occurrences of a word, from 0, from the lengths of the pieces between them."""
    p = f"string_split({text}, {word})"
    return f"list_transform(range(1, len({p})), lambda i: (list_sum(list_transform(({p})[1:i], lambda z: len(z)))::BIGINT + (i - 1) * len({word}))::INT)"


def mentions(markers: list[str], lookahead: int, pattern: str) -> str:
    """Common tables hits, chosen, selected, marks, matches and candidates over nodes and titles."""
    marks = ", ".join(f"('{m}')" for m in markers)
    return f"""
hits AS (
  SELECT doc_id, ordinal, title, s AS start, s + len(title) AS stop FROM (
    SELECT doc_id, ordinal, title, unnest({starts("text", "title")}) AS s FROM nodes JOIN titles ON contains(text, title))),
listed AS (SELECT doc_id, ordinal, list({{'n': -len(title), 't': title, 's': start, 'e': stop}} ORDER BY -len(title), title, start) AS h FROM hits GROUP BY ALL),
chosen AS (
  SELECT doc_id, ordinal, list_reduce(list_transform(h, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END) AS sel
  FROM listed),
flat AS (SELECT doc_id, ordinal, u.s AS start, u.e AS stop, u.t AS title FROM (SELECT doc_id, ordinal, unnest(sel) AS u FROM chosen)),
selected AS (
  SELECT f.*, n.text, coalesce(lead(start) OVER (PARTITION BY f.doc_id, f.ordinal ORDER BY start), len(n.text)) AS next
  FROM flat f JOIN nodes n USING (doc_id, ordinal)),
marks(word) AS (VALUES {marks}),
markhits AS (
  SELECT doc_id, ordinal, word, s AS start FROM (SELECT doc_id, ordinal, word, unnest({starts("text", "word")}) AS s FROM nodes JOIN marks ON contains(text, word))),
uncovered AS (
  SELECT doc_id, ordinal, word, min(start) AS first FROM markhits m
  WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.doc_id = m.doc_id AND f.ordinal = m.ordinal AND f.start < m.start + len(m.word) AND m.start < f.stop) GROUP BY ALL),
examined AS (
  SELECT n.doc_id, n.ordinal, (coalesce(h.c, 0) + coalesce(k.c, 0))::INT AS matches FROM nodes n
  LEFT JOIN (SELECT doc_id, ordinal, count(*) AS c FROM hits GROUP BY ALL) h USING (doc_id, ordinal)
  LEFT JOIN (SELECT m.doc_id, m.ordinal, count(*) AS c FROM markhits m LEFT JOIN uncovered u USING (doc_id, ordinal, word) WHERE u.first IS NULL OR m.start <= u.first GROUP BY ALL) k USING (doc_id, ordinal)),
candidates AS (
  SELECT doc_id, ordinal, start, title, nullif(regexp_extract(substr(text, stop + 1, least({lookahead}, next - stop)), '{pattern}'), '') AS provision FROM selected
  UNION ALL SELECT doc_id, ordinal, min(first), NULL, NULL FROM uncovered GROUP BY doc_id, ordinal)"""


#: Status, reason and evidence of the distinct references as of a day.
RESOLVED = """
last AS (SELECT record_seq, max(version_seq) AS version_seq FROM versions GROUP BY 1),
newest AS (SELECT v.record_seq, v.effective_from, v.title, p.canonical_id, p.label FROM last JOIN versions v USING (record_seq, version_seq) JOIN provisions p USING (record_seq, version_seq)),
pairs AS (SELECT DISTINCT title, provision FROM candidates),
reached AS (
  SELECT c.title, c.provision, v.record_seq, v.version_seq, v.record_id, v.effective_from, v.effective_to,
    v.effective_from <= DATE '{as_of}' AND (v.effective_to IS NULL OR DATE '{as_of}' < v.effective_to) AS eff,
    p.label IS NOT NULL AS hit, p.label IS NOT NULL AND n.title IS NULL AS ended, coalesce(n.title = v.title AND n.label = p.label, false) AS same,
    CASE WHEN p.label IS NOT NULL AND n.title IS NOT NULL AND NOT (n.title = v.title AND n.label = p.label) THEN n.effective_from::VARCHAR || '/' || n.title || '/' || n.label END AS change
  FROM pairs c JOIN versions v ON c.title = v.title
  LEFT JOIN provisions p ON p.record_seq = v.record_seq AND p.version_seq = v.version_seq AND p.label = c.provision
  LEFT JOIN newest n ON n.record_seq = v.record_seq AND n.canonical_id = p.canonical_id),
told AS (SELECT *, record_id || '|' || effective_from::VARCHAR || '|' || coalesce(effective_to::VARCHAR, '') AS head FROM reached),
counted AS (
  SELECT title, provision, count_if(eff) AS tm, count_if(eff AND hit) AS ex, count_if(hit) AS hi, bool_or(eff AND hit AND ended) AS ended, bool_or(eff AND hit AND same) AS same,
    string_agg(head || '|' || CASE WHEN hit THEN provision ELSE '' END || '|' || coalesce(change, ''), ';' ORDER BY record_seq, version_seq) FILTER (WHERE eff) AS by_title,
    string_agg(head || '||', ';' ORDER BY record_seq, version_seq) FILTER (WHERE eff) AS bare,
    string_agg(head || '|' || provision || '|' || coalesce(change, ''), ';' ORDER BY record_seq, version_seq) FILTER (WHERE eff AND hit) AS exact,
    string_agg(head || '|' || provision || '|' || coalesce(change, ''), ';' ORDER BY record_seq, version_seq) FILTER (WHERE hit) AS ever
  FROM told GROUP BY ALL),
resolved AS (
  SELECT p.title, p.provision,
    CASE WHEN p.title IS NULL THEN 'UNKNOWN' WHEN tm > 1 THEN 'REVIEW' WHEN ex = 1 AND ended THEN 'REVIEW' WHEN ex = 1 AND same THEN 'CURRENT' WHEN ex = 1 THEN 'HISTORY' WHEN tm = 1 THEN 'REVIEW' WHEN hi > 0 THEN 'REVIEW' ELSE 'UNKNOWN' END AS status,
    CASE WHEN p.title IS NULL THEN 'AMBIGUOUS_CITATION' WHEN tm > 1 THEN 'CONFLICTING_EVIDENCE' WHEN ex = 1 AND ended THEN 'CONFLICTING_EVIDENCE' WHEN ex = 1 AND same THEN 'EXACT_CURRENT_MATCH' WHEN ex = 1 THEN 'EXACT_HISTORICAL_MATCH' WHEN tm = 1 THEN 'PROVISION_MISMATCH' WHEN hi > 0 THEN 'CONFLICTING_EVIDENCE' ELSE 'CATALOG_NO_MATCH' END AS reason_code,
    CASE WHEN p.title IS NULL THEN '' WHEN tm > 1 THEN by_title WHEN ex = 1 THEN exact WHEN tm = 1 THEN bare WHEN hi > 0 THEN ever ELSE '' END AS evidence
  FROM pairs p LEFT JOIN counted c ON p.title IS NOT DISTINCT FROM c.title AND p.provision IS NOT DISTINCT FROM c.provision),
items AS (
  SELECT c.doc_id, c.ordinal, c.start, c.title, c.provision, r.status, r.reason_code, r.evidence, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, start)::INT AS item_number
  FROM candidates c JOIN resolved r ON c.title IS NOT DISTINCT FROM r.title AND c.provision IS NOT DISTINCT FROM r.provision)"""

#: Ledgers made of the event stream: one a user, three of the event types as actions.
LEDGERS = """
acts AS (
  SELECT user_id AS ledger, event_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'click' THEN 'decide' END AS action,
    ((props::JSON->>'k')::INT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS "at" FROM events WHERE event_type IN ('view', 'purchase', 'click')),
events0 AS (
  SELECT ledger, row_number() OVER (PARTITION BY ledger ORDER BY event_id)::INT AS sequence, action,
    CASE WHEN action = 'decide' THEN k % 10 + 1 END AS item_number, CASE WHEN action = 'decide' THEN ['confirm', 'reject', 'investigate', 'defer'][k % 4 + 1] END AS disposition,
    CASE WHEN action <> 'decide' THEN ['triage', 'evidence', 'decision'][k % 3 + 1] END AS stage, "at" FROM acts),
heads AS (SELECT DISTINCT user_id AS ledger, 10 AS n_items FROM events)"""

#: Reports made of order lines: "before" as they are, "after" with lines dropped, moved to other statuses and added.
ITEMS = """
lines AS (SELECT l_orderkey AS pair, 'L' || l_linenumber AS locator, 'S' || (l_suppkey % 3) AS title, CASE WHEN l_partkey % 4 > 0 THEN 'P' || (l_partkey % 5) END AS provision,
    l_returnflag AS status, l_linestatus AS reason_code, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice, l_quantity FROM lineitem),
old AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::INT AS item_number FROM lines),
new AS (
  SELECT pair, locator, CASE WHEN l_partkey % 19 = 0 THEN 'S9' ELSE title END AS title, provision, CASE WHEN l_suppkey % 5 = 0 THEN 'X' ELSE status END AS status, reason_code, l_partkey,
    row_number() OVER (PARTITION BY pair ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)::INT AS item_number
  FROM lines WHERE l_partkey % 17 <> 0),
pos AS (SELECT o.pair, o.item_number FROM old o JOIN new n USING (pair, item_number) WHERE o.locator = n.locator AND o.title = n.title AND o.provision IS NOT DISTINCT FROM n.provision),
oc AS (SELECT *, count(*) OVER (PARTITION BY pair, locator, title, provision) AS ids, count(*) OVER (PARTITION BY pair, title, provision) AS refs FROM old),
nc AS (SELECT *, count(*) OVER (PARTITION BY pair, locator, title, provision) AS ids, count(*) OVER (PARTITION BY pair, title, provision) AS refs FROM new),
uo AS (SELECT *, row_number() OVER (PARTITION BY pair, title, provision ORDER BY item_number) AS rk FROM oc WHERE (pair, item_number) NOT IN (SELECT (pair, item_number) FROM pos)),
un AS (SELECT * FROM nc WHERE (pair, item_number) NOT IN (SELECT (pair, item_number) FROM pos)),
part AS (SELECT pair, title, provision, string_agg(item_number::VARCHAR, ',' ORDER BY item_number) AS ns FROM un GROUP BY ALL),
jo AS (
  SELECT u.*, p.ns,
    (SELECT count(*) FROM new n WHERE n.pair = u.pair AND n.locator = u.locator AND n.title = u.title AND n.provision IS NOT DISTINCT FROM u.provision) AS nids,
    (SELECT count(*) FROM new n WHERE n.pair = u.pair AND n.title = u.title AND n.provision IS NOT DISTINCT FROM u.provision) AS nrefs
  FROM uo u LEFT JOIN part p ON u.rk = 1 AND p.pair = u.pair AND p.title = u.title AND p.provision IS NOT DISTINCT FROM u.provision),
fr AS (
  SELECT u.*,
    (SELECT count(*) FROM old n WHERE n.pair = u.pair AND n.locator = u.locator AND n.title = u.title AND n.provision IS NOT DISTINCT FROM u.provision) AS oids,
    (SELECT count(*) FROM old n WHERE n.pair = u.pair AND n.title = u.title AND n.provision IS NOT DISTINCT FROM u.provision) AS orefs
  FROM un u WHERE NOT EXISTS (SELECT 1 FROM uo c WHERE c.pair = u.pair AND c.title = u.title AND c.provision IS NOT DISTINCT FROM u.provision))"""
