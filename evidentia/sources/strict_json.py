"""Strict JSON: unique keys, finite numbers, bounded size, depth and node count; and the canonical digest."""

from __future__ import annotations

import hashlib
import json
import math
import os
import stat
from pathlib import Path
from typing import Any

from evidentia.errors import JSON_INVALID, OUTPUT_EXISTS, EvidenceError

MAX_BYTES, MAX_DEPTH, MAX_NODES = 8 * 1024 * 1024, 32, 200_000


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def parse(data: bytes) -> Any:
    """Value of UTF-8 JSON without a byte order mark; ValueError for anything looser (over-long integers included)."""
    return json.loads(data.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_no_constant)


def check_bounds(value: Any, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> None:
    """ValueError unless a value is plain JSON of bounded depth and size, with finite numbers and encodable strings."""
    todo, nodes = [(value, 1)], 0
    while todo:
        v, depth = todo.pop()
        nodes += 1
        if nodes > max_nodes or depth > max_depth:
            raise ValueError("too large or too deep")
        if isinstance(v, dict):
            for k in v:
                k.encode("utf-8")
            todo += [(x, depth + 1) for x in v.values()]
        elif isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
        elif isinstance(v, str):
            v.encode("utf-8")
        elif isinstance(v, float) and not math.isfinite(v):
            raise ValueError("not finite")
        elif not (v is None or isinstance(v, (bool, int, float))):
            raise ValueError("not JSON")


def canonical(value: Any) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode("utf-8")


def digest(value: Any) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def safe_path(path: Path, existing: bool) -> os.stat_result | None:
    """Status of a regular, singly linked file reached through no symbolic link; None for a free name if that will do."""
    bad = EvidenceError("REVIEW_PATH_INVALID", "Review path is not a safe regular path.")
    whole = path.absolute()
    for part in [*reversed(whole.parents), whole]:
        try:
            info = part.lstat()
        except FileNotFoundError:
            if part == whole and not existing:
                return None
            raise bad from None
        except OSError:
            raise bad from None
        if stat.S_ISLNK(info.st_mode) or (part != whole and not stat.S_ISDIR(info.st_mode)):
            raise bad
    if not stat.S_ISREG(info.st_mode) or info.st_nlink != 1:
        raise bad
    return info


def _mark(info: os.stat_result) -> tuple:
    return info.st_dev, info.st_ino, info.st_size, info.st_mtime_ns


def read_object(path: Path, max_bytes: int = MAX_BYTES) -> dict:
    """A JSON object from a file that stays the same file while it is read."""
    bad = EvidenceError(*JSON_INVALID)
    before = safe_path(path, existing=True)
    try:
        with path.open("rb") as f:
            opened = os.fstat(f.fileno())
            data = f.read(max_bytes + 1)
            after = os.fstat(f.fileno())
    except OSError:
        raise EvidenceError("REVIEW_PATH_INVALID", "Review path cannot be read.") from None
    if len({_mark(before), _mark(opened), _mark(after), _mark(safe_path(path, existing=True))}) != 1 or len(data) > max_bytes:
        raise bad
    try:
        value = parse(data)
        check_bounds(value)
    except (ValueError, RecursionError):
        raise bad from None
    if not isinstance(value, dict):
        raise bad
    return value


def write_new(path: Path, data: bytes, inputs: list[Path] = ()) -> None:
    """Create a file that does not exist and is none of the inputs; a partial file stays on failure."""
    if any(path.absolute() == p.absolute() for p in inputs):
        raise EvidenceError("REVIEW_PATH_INVALID", "Output must differ from the inputs.")
    if safe_path(path, existing=False) is not None:
        raise EvidenceError(*OUTPUT_EXISTS)
    try:
        with path.open("xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
    except FileExistsError:
        raise EvidenceError(*OUTPUT_EXISTS) from None
    except OSError:
        raise EvidenceError("REVIEW_OUTPUT_FAILED", "Output could not be written.", 1) from None
