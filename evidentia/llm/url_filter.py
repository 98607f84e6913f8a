"""URL filters: all glob rules at once by bit-parallel Shift-And over canonical URLs.

A rule is one string over ``.`` and the canonical URL, ``host + path``.  Its positions are bits in 64-bit words: a literal
byte, ``?`` (any byte), ``~`` (a byte between words: ``. - _ :``), ``*`` (any run of bytes) or ``^`` (any run of bytes but
``/``).  One step moves the states of all rules: shift, mask with the byte's table, and stay where a run allows it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: URLs advanced together, and bytes of padded text in one such block at most.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 22


#: Bytes that stand between words of a host.
BETWEEN = b".-_:"


class GlobSet:
    """Shift-And masks of many anchored globs."""

    def __init__(self, globs: list[str]):
        offsets, last, width = [], [], 0
        cells: list[list[tuple[bytes | None, str]]] = []
        for g in globs:
            atoms: list[tuple[bytes | None, str]] = []  # (bytes that fit or None for any, the run that may stand before it)
            run = ""
            for ch in g:
                if ch in "*^":
                    run = "*" if "*" in (ch, run) else "^"
                elif ch == "~":
                    atoms.append((BETWEEN, run))
                    run = ""
                else:
                    atoms += [(None if ch == "?" else bytes([b]), run if i == 0 else "") for i, b in enumerate(ch.encode())]
                    run = ""
            atoms.append((b"\0", run))  # the end of the URL is a byte too
            cells.append(atoms)
            offsets.append(width)
            width += len(atoms) + 1
            last.append(width - 1)
        self.words = max(1, -(-width // 64))
        self.take = np.zeros((256, self.words), dtype=np.uint64)  # a byte enters the position
        self.stay = np.zeros((256, self.words), dtype=np.uint64)  # a byte is skipped by a run that waits here
        self.init = np.zeros(self.words, dtype=np.uint64)
        self.last = last
        for at, atoms in zip(offsets, cells, strict=True):
            self._set(self.init, at)
            for i, (byte, run) in enumerate(atoms):
                for b in range(1, 256) if byte is None else byte:
                    self._set(self.take[b], at + i + 1)
                for b in range(1, 256) if run else ():
                    if run == "*" or b != 0x2F:
                        self._set(self.stay[b], at + i)

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """(urls, globs) booleans; a NUL byte in a URL is read as byte 1."""
        out = np.zeros((len(urls), len(self.last)), dtype=bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        at = 0
        while at < len(order):
            upto = at
            while upto < len(order) and upto - at < BLOCK_ROWS and (upto == at or (upto - at + 1) * (len(urls[order[upto]]) + 1) <= BLOCK_BYTES):
                upto += 1
            block = order[at:upto]
            width = len(urls[block[-1]]) + 1
            size = np.array([len(urls[i]) for i in block])
            text = np.frombuffer(b"".join(urls[i].replace(b"\0", b"\1").ljust(width, b"\0") for i in block), dtype=np.uint8).reshape(len(block), width)
            state = np.repeat(self.init[None, :], len(block), axis=0)
            for step in range(width):
                moved = state << np.uint64(1)
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
                b = text[:, step]
                after = (moved & self.take[b]) | (state & self.stay[b])
                done = step > size  # past the end byte: the state rests
                state = np.where(done[:, None], state, after) if done.any() else after
            for g, bit in enumerate(self.last):
                out[block, g] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            at = upto
        return out


#: Listed rules: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The method's own rules by category, for URLs that no listed rule fits: words of host names.
UNWANTED = {
    "gambling": "casino casinos poker-room pokerstars free-bets sportsbet betting-tips online-slots slot-machine slot-machines jackpot-win roulette bingo-hall lottery-win".split(),
    "adult": "adult-x adultfriend pornhub porn-tube porno xvideos xhamster sex-cam sexshop camgirl escort-service hentai milf".split(),
    "pharmacy": "cheap-pills viagra cialis tramadol online-pharmacy pharmacy-online diet-pills weight-loss-pill weight-loss-pills".split(),
    "spam": "spam-farm link-farm linkfarm seo-farm article-spinner buy-backlinks free-ringtones make-money-fast get-rich get-rich-quick payday-loan payday-loans replica-watch replica-watches".split(),
    "piracy": "warez keygen crackz torrent-download torrentz piratebay free-movies-online nulled-scripts serial-key".split(),
    "adverts": "ads-track adserver ad-server adservice adclick doubleclick popunder clickbank trackclick affiliate-link banner-exchange".split(),
    "malware": "phishing free-antivirus-scan trojan-download malware-host botnet".split(),
}
#: Further globs, over host and path: hosts of adverts, and parts of paths.
UNWANTED_GLOBS = ["^.ads.*", "^.ad?server.*", "*/cgi-bin/ad*", "*/adclick/*", "*/affiliate/?*", "*/doorway~*", "*/popunder~*", "*/wp-content/uploads/*.exe"]


def host_globs(words: list[str]) -> list[str]:
    """Globs of hosts that hold one of these words whole, between dots, hyphens or the like, or at the URL's end."""
    return [g for w in words for g in (f"^~{w}~*", f"^~{w}/*", f"^~{w}")]


BLOCK_GLOBS = [*host_globs([w for words in UNWANTED.values() for w in words]), *UNWANTED_GLOBS]
#: Globs that a table of them may hold: a worker keeps two bits a byte value for each of their characters.
MAX_GLOBS = 20_000


def globs_of(rules) -> list[str]:
    """Globs from a list, or from the first column of a table of at most MAX_GLOBS; null and empty ones are left out."""
    if isinstance(rules, DataFrame):
        rows = rules.select(F.col(rules.columns[0]).cast("string").alias("glob")).where("glob <> ''").distinct().limit(MAX_GLOBS + 1).collect()
        rules = sorted(r["glob"] for r in rows)
    if len(rules) > MAX_GLOBS:
        raise ValueError(f"more than {MAX_GLOBS} globs")
    return [g for g in rules if g]


def glob_pattern(glob: str) -> str:
    """The same glob as a regular expression over ``.`` and a whole URL."""
    return "".join({"*": ".*", "^": "[^/]*", "?": ".", "~": "[-._:]"}.get(c, c if c.isalnum() else f"[{c}]") for c in glob)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules=RULES, block_globs=BLOCK_GLOBS, id_column: str = "page_id", url: str = "url") -> DataFrame:
    """Per row (id, host, path, rule, verdict).

    The longest listed rule (host and path together; ties: the earlier) that fits decides and is named in ``rule``;
    otherwise ``rule`` is null and the verdict is ``block`` where one of ``block_globs`` matches (a list, or a table whose first
    column holds them), else ``allow``.  A null URL or one
    without ``://`` has empty host and path, which no listed rule fits.  Repeated rows are judged alike, other columns
    left out, an empty table gives an empty table; the length of a URL is not limited.
    """
    names = [h + p for h, p, _ in rules]
    verdicts = [v for _, _, v in rules]
    best = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))
    listed = len(rules)
    globs = [f"^.{h}{p}*" for h, p, _ in rules] + globs_of(block_globs)
    for h, p, _ in rules:
        assert not set(h + p) & set("*?^~"), "listed rules are literal"

    def run(batches):
        made = GlobSet(globs)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hit = made.match([f".{h}{p}".encode() for h, p in zip(hosts, paths, strict=True)])
            fits = hit[:, :listed]
            blocked = hit[:, listed:].any(axis=1)
            rule: list = [None] * len(hosts)
            verdict = np.where(blocked, "block", "allow").tolist()
            for i in np.flatnonzero(fits.any(axis=1)).tolist():
                k = next(k for k in best if fits[i, k])
                rule[i], verdict[i] = names[k], verdicts[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    seen = pages.select(F.col(id_column).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = seen.mapInArrow(run, f"id {dict(pages.dtypes)[id_column]}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_column)


#: DuckDB: the same judgement by string functions.
ORACLE = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fit AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_full_match('.' || host || path, '(?s)(?:{"|".join(map(glob_pattern, BLOCK_GLOBS))})') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""
