"""The dated catalog: strict loading of version "1" and the two flat tables that queries use."""

from __future__ import annotations

import hashlib
import re
from datetime import date, datetime
from pathlib import Path
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidentia.errors import CATALOG_NOT_FOUND, EvidenceError
from evidentia.sources import strict_json

VERSIONS = T.StructType([T.StructField(n, t, null) for n, t, null in (("record_seq", T.IntegerType(), False), ("version_seq", T.IntegerType(), False), ("record_id", T.StringType(), False), ("official_source", T.StringType(), False), ("retrieved_at", T.StringType(), False), ("effective_from", T.DateType(), False), ("effective_to", T.DateType(), True), ("title", T.StringType(), False))])
PROVISIONS = T.StructType([T.StructField(n, t, False) for n, t in (("record_seq", T.IntegerType()), ("version_seq", T.IntegerType()), ("provision_seq", T.IntegerType()), ("canonical_id", T.StringType()), ("label", T.StringType()))])
TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})", re.ASCII)


class _Invalid(ValueError):
    pass


def _need(ok: bool) -> None:
    if not ok:
        raise _Invalid


def _object(value: Any, keys: str) -> dict:
    _need(isinstance(value, dict) and set(value) == set(keys.split()))
    return value


def _list(value: Any) -> list:
    _need(isinstance(value, list) and bool(value))
    return value


def _text(value: Any) -> str:
    _need(isinstance(value, str) and bool(value.strip()))
    return value


def strict_day(value: Any) -> date:
    day = date.fromisoformat(_text(value))
    _need(day.isoformat() == value)
    return day


def _timestamp(value: Any) -> str:
    _need(TIMESTAMP.fullmatch(_text(value)) is not None)
    whole, fraction = re.sub(r"\.\d+", "", value), re.search(r"\.(\d+)", value)
    datetime.fromisoformat(whole.replace("Z", "+00:00"))
    _need(fraction is None or bool(fraction[1]))
    return value


def _source(value: Any) -> str:
    url = _text(value)
    _need("\\" not in url and not any(c.isspace() or ord(c) < 32 or 127 <= ord(c) < 160 for c in url))
    parts = urlsplit(url)
    _need(parts.scheme == "https" and bool(parts.hostname) and parts.username is None and parts.password is None)
    _need(parts.port is None or parts.port >= 0)
    return url


def _flatten(raw: Any) -> tuple[list[tuple], list[tuple]]:
    versions, provisions = [], []
    ids = set()
    for r, record in enumerate(_list(raw["records"])):
        _object(record, "record_id official_source versions")
        source = _object(record["official_source"], "url retrieved_at")
        key = _text(record["record_id"])
        _need(key not in ids)
        ids.add(key)
        head = (key, _source(source["url"]), _timestamp(source["retrieved_at"]))
        spans = []
        for v, version in enumerate(_list(record["versions"])):
            _object(version, "effective_from effective_to title provisions")
            start = strict_day(version["effective_from"])
            end = None if version["effective_to"] is None else strict_day(version["effective_to"])
            _need(end is None or start < end)
            _need(not spans or (spans[-1][1] is not None and spans[-1][1] <= start))
            spans.append((start, end))
            versions.append((r, v, *head, start, end, _text(version["title"])))
            seen: tuple[set, set] = (set(), set())
            for p, provision in enumerate(_list(version["provisions"])):
                _object(provision, "canonical_id label")
                pair = _text(provision["canonical_id"]), _text(provision["label"])
                for s, x in zip(seen, pair, strict=True):
                    _need(x not in s)
                    s.add(x)
                provisions.append((r, v, p, *pair))
        _need(spans[-1][1] is None)
    return versions, provisions


class Catalog:
    """A validated catalog as two DataFrames, the hash of its bytes, and its titles."""

    def __init__(self, versions: DataFrame, provisions: DataFrame, sha256: str, titles: list[str]):
        self.versions, self.provisions, self.sha256, self.titles = versions, provisions, sha256, titles


def parse_catalog(data: bytes) -> tuple[list[tuple], list[tuple]]:
    try:
        raw = strict_json.parse(data)
    except (ValueError, RecursionError):
        raise EvidenceError("CATALOG_JSON_INVALID", "Catalog is not valid JSON.") from None
    if isinstance(raw, dict) and set(raw) == {"schema_version", "records"} and isinstance(raw["schema_version"], str) and raw["schema_version"] != "1":
        raise EvidenceError("CATALOG_SCHEMA_UNSUPPORTED", "Catalog schema version is not supported.")
    try:
        _object(raw, "schema_version records")
        _need(raw["schema_version"] == "1")
        return _flatten(raw)
    except (ValueError, KeyError, TypeError):
        raise EvidenceError("CATALOG_SCHEMA_INVALID", "Catalog does not match its schema.") from None


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows the driver has, as a local relation: the planner knows its size and broadcasts it while small."""
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=arrow), schema)


def catalog_frames(spark: SparkSession, data: bytes) -> Catalog:
    versions, provisions = parse_catalog(data)
    return Catalog(local_frame(spark, versions, VERSIONS), local_frame(spark, provisions, PROVISIONS), hashlib.sha256(data).hexdigest(), sorted({v[-1] for v in versions}))


def load_catalog(spark: SparkSession, path: str | Path) -> Catalog:
    path = Path(path)
    if not path.is_file():
        raise EvidenceError(*CATALOG_NOT_FOUND)
    try:
        data = path.read_bytes()
    except OSError:
        raise EvidenceError("CATALOG_NOT_READABLE", "Catalog cannot be read.") from None
    return catalog_frames(spark, data)
