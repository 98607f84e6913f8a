"""Quality classifier by compression: two zstandard dictionaries, one from good and one from bad text.

A whole text is compressed with each in blocks, each block apart, so that a dictionary tells as much of the end of a long text as
of its beginning.  The difference of the compressed sizes over the raw size is calibrated to a probability by a logistic fit,
whose curve depends on the length: the difference of a short text is noisier.  The dictionaries and the calibration learn from
disjoint folds of the labelled rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a dictionary, of a block that is compressed with it, and of the samples that a text is cut into to train one.
DICT_BYTES, LEVEL, BLOCK, SAMPLE = 262_144, 3, 512, 2_000
#: Fit bound: labelled rows per class and fold, with their whole texts.
FIT_ROWS = 2_500


def fold(id_column: str):
    """crc32 of the id written as text, modulo 3: 0 builds dictionaries, 2 calibrates, 1 is held out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 3


def make_dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself serves as one."""
    pieces = [p for p in pieces if p]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICT_BYTES:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**plain)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, **plain)


def features(sizes: np.ndarray) -> np.ndarray:
    """Rows of (good size, bad size, raw size) to the normalised difference, what the length tells of its noise, and products."""
    good, bad, raw = sizes.astype(float).T
    difference, short = (bad - good) / np.maximum(raw, 1), 4 / np.log2(raw + 2)
    return np.stack([difference, short, difference * difference, difference * short, short * short], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 100) -> dict:
    """Ridge logistic regression by damped Newton steps; a constant where one class is missing."""
    if not len(y) or y.min() == y.max():
        return {"mean": [0.0] * x.shape[1], "scale": [1.0] * x.shape[1], "w": [0.0] * x.shape[1], "b": 0.0 if not len(y) else 2.0 * (1 if y[0] else -1)}
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    keep = np.r_[0.0, np.full(x.shape[1], ridge * len(x))]
    w = np.zeros(z.shape[1])

    def loss(v):
        m = z @ v
        return np.logaddexp(0, m).sum() - y @ m + 0.5 * (keep * v * v).sum()

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-6), z.T @ (p - y) + keep * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, last, now = w - size * step, now, loss(w - size * step)
        if last - now < 1e-7 * len(y):
            break
    return {"mean": mean.tolist(), "scale": scale.tolist(), "w": w[1:].tolist(), "b": float(w[0])}


def predict(model: dict, sizes: np.ndarray) -> np.ndarray:
    z = (features(sizes) - np.asarray(model["mean"])) / np.asarray(model["scale"])
    return 1 / (1 + np.exp(-np.clip(z @ np.asarray(model["w"]) + model["b"], -35, 35)))


def compressed_size(c: zstandard.ZstdCompressor, raw: bytes) -> int:
    return sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK))


def measure(texts, good, bad) -> np.ndarray:
    """(good size, bad size, raw size) of each text; null is empty, and an empty text is (0, 0, 0)."""
    out = np.empty((len(texts), 3), dtype=np.int64)
    for i, t in enumerate(texts):
        raw = (t.as_py() or "").encode()
        out[i] = compressed_size(good, raw), compressed_size(bad, raw), len(raw)
    return out


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Dictionaries and calibration from labelled rows outside the held-out fold.

    At most FIT_ROWS rows per class and fold are used, those with the smallest hashes of their ids; null and other labels
    are left out, an id with both labels counts as bad.  FIT_ROWS bounds what reaches the driver: the whole texts of fold 0, and
    three sizes a row of fold 2.  Empty and null texts teach the dictionaries nothing; without rows of both classes the score
    is constant; repeated rows count as often as they stand; extra columns are not read.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"), fold(id_column).alias("fold")).where("id IS NOT NULL AND y IN (0, 1) AND fold <> 1")
    marked = marked.groupBy("id", "fold").agg(F.min("y").alias("y"))
    few = None
    for f in (0, 2):
        for y in (0, 1):
            part = marked.where((F.col("fold") == f) & (F.col("y") == y)).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
            few = part if few is None else few.unionByName(part)
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id")  # at most 4 * FIT_ROWS ids
    rows = chosen.where("fold = 0").select("y", "id", "text").orderBy("y", F.xxhash64("id"), "id", "text").collect()
    cut = {y: [raw[i : i + SAMPLE] for r in rows if r["y"] == y for raw in [(r["text"] or "").encode()] for i in range(0, len(raw), SAMPLE)] for y in (0, 1)}
    model = {"good": make_dictionary(cut[1]), "bad": make_dictionary(cut[0])}
    both = spark.sparkContext.broadcast(model)

    def sizes(batches):
        good, bad = compressor(both.value["good"]), compressor(both.value["bad"])
        for b in batches:
            got = measure(b.column(2), good, bad)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, i]) for i in range(3))], names=["id", "y", "g", "q", "n"])

    kind = dict(docs.dtypes)[id_column]
    seen = chosen.where("fold = 2").select("id", "y", "text").mapInArrow(sizes, f"id {kind}, y int, g long, q long, n long").orderBy("id", "g", "q").collect()
    x = np.array([[r["g"], r["q"], r["n"]] for r in seen], dtype=np.int64).reshape(-1, 3)
    y = np.array([r["y"] for r in seen], dtype=float)
    return model | {"fit": json.dumps(fit_logistic(features(x), y))}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Score every whole text: (id, held_out, score, predicted), or with ``keep`` all columns plus ``quality_score``.

    A null text counts as empty and gets the score of an empty text; a text of any length is read whole.  Equal texts get equal scores; repeated rows stay;
    an empty table gives an empty table.  Other columns pass through, whatever their names; one called
    ``quality_score`` stands before the added one.  Without labels of both classes the score is constant.
    """
    both = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = both.value
        good, bad, fit = compressor(m["good"]), compressor(m["bad"]), json.loads(m["fit"])
        for b in batches:
            s = predict(fit, measure(b.column(b.num_columns - 1), good, bad))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "quality_score"])

    if keep:
        names = [f"c{i}" for i in range(len(docs.columns))]
        plain = docs.toDF(*names)
        schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
        out = plain.select(*names, F.col(names[docs.columns.index(text)]).alias("scored")).mapInArrow(run, f"{schema}, quality_score double")
        return out.toDF(*docs.columns, "quality_score")
    kind = dict(docs.dtypes)[id_column]
    out = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, quality_score double")
    return out.select(F.col("id").alias(id_column), F.coalesce(fold("id") == 1, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
