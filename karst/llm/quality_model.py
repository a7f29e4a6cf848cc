"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A word contributes its own hash and the hash of its shape (runs of letters, capitals, digits and each
punctuation mark, collapsed); the features are word 1- and 2-grams and shape 1-, 2- and 3-grams, hashed to ``DIMENSIONS`` and
weighed by count over the vector's length.  Only the text is an input.  Scores are sparse dot products through the logistic function.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents of up to ``TRAIN_BYTES``, those with the smallest hashes of doc_id, however
large the corpus is, one row each; everything is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._work import pick, ship

DIMENSIONS = 1 << 18
TRAIN_ROWS, TRAIN_BYTES = 8192, 1 << 15
#: At least EPOCHS passes over the training rows, and more (up to MOST_EPOCHS) where they make fewer than UPDATES updates.
EPOCHS, MOST_EPOCHS, UPDATES = 3, 30, 20_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
_U = np.uint64
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum(T._BYTE[data] * T._power(T._R, n), out=total[1:])
    return T.mix((total[end] - total[start]) * T._power(T._RINV, n + 1)[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93) + _U(salt))


def _grams(h: np.ndarray, row: np.ndarray, width: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    v, bound = T.shingle_hashes(h, row, width, short=False)
    return T.mix(v ^ _U(salt)), np.repeat(np.arange(len(row) - 1), np.diff(bound))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, indices, values) of a slice's rows; index 0 is the constant."""
    w = T.Words(data, offs, lower=False)
    kind = _CLASS[data]
    new = np.zeros(len(data) + 1, bool)
    new[w.start] = True
    inside = ~T._IS_SPACE[data]
    new[1:-1] |= inside[1:] & (kind[1:] != kind[:-1])
    new = new[:-1] & inside
    rank = np.concatenate([[0], np.cumsum(new)])
    shape = _spans(kind[new], rank[w.start], rank[w.end], 1)
    word = w.hashes()
    parts = [(word, 1, 11), (word, 2, 12), (shape, 1, 13), (shape, 2, 14), (shape, 3, 15)]
    hs, rows = zip(*(_grams(h, w.row, k, s) for h, k, s in parts), strict=True)
    h, r = np.concatenate(hs), np.concatenate(rows)
    code = r.astype(np.int64) * DIMENSIONS + 1 + (h % _U(DIMENSIONS - 1)).astype(np.int64)
    code = np.concatenate([code, np.arange(len(offs) - 1) * DIMENSIONS])
    code, count = np.unique(code, return_counts=True)
    r, index = code // DIMENSIONS, code % DIMENSIONS
    value = np.sqrt(count)
    value[index == 0] = 0
    norm = np.sqrt(np.bincount(r, value * value, minlength=len(offs) - 1))
    value = np.where(index == 0, 1.0, value / np.maximum(norm, 1e-9)[r])
    return np.searchsorted(r, np.arange(len(offs))), index, value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _train_rows(batches):
    for batch in batches:
        order, label = batch.column("ord"), batch.column("label")
        for a, b, data, offs in T.slices(batch.column("text")):
            bound, index, value = features(data, offs)
            yield pa.RecordBatch.from_arrays([order.slice(a, b - a), label.slice(a, b - a), *(pa.array([x[bound[i] : bound[i + 1]].tobytes() for i in range(b - a)], pa.binary()) for x in (index.astype(np.int32), value.astype(np.float32)))], ["ord", "label", "index", "value"])


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("ord")
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64), y) for i, v, y in zip(table["index"].to_pylist(), table["value"].to_pylist(), table["label"].to_pylist(), strict=True)]
    z, n, w = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, -(-UPDATES // max(1, len(rows)))))):
        for i, v, y in rows:
            g = (_sigmoid(w[i] @ v) - y) * v
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / ALPHA * w[i]
            n[i] = more
            s = z[i]
            w[i] = np.where(np.abs(s) <= L1, 0, -(s - np.sign(s) * L1) / ((BETA + np.sqrt(more)) / ALPHA + L2))
    return pa.table({"weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> np.ndarray:
    """Weights from ``labels(doc_id, quality)`` of ``docs(doc_id, text)``, without the held-out fifth.

    Learned from are at most ``rows`` documents with a text of up to ``size`` bytes.  Labels that are null are left out; of several labels of one document the largest
    counts, of several texts of one doc_id the one with the smallest hash.  Without any label, or any document that has one, all weights are 0.
    """
    ship(docs.sparkSession)
    labels = pick(labels, doc_id="long", quality="int").where("quality IS NOT NULL AND doc_id IS NOT NULL")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
    texts = pick(docs, doc_id="long", text="string").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= size).withColumn("name", F.xxhash64("text"))
    one = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("name").alias("name"))
    chosen = one.join(labels, "doc_id").select("doc_id", "name", "label", F.xxhash64("doc_id").alias("ord")).orderBy("ord", "doc_id").limit(rows)
    # at most ``rows`` rows of 28 bytes are sent to the executors; rows repeated whole meet in the aggregation, one from each task
    sample = texts.join(F.broadcast(chosen), ["doc_id", "name"]).groupBy("doc_id", "ord", "label").agg(F.min("text").alias("text"))
    vectors = sample.select("ord", "label", "text").mapInArrow(_train_rows, "ord long, label int, index binary, value binary")
    got = vectors.groupBy(F.lit(0).alias("all")).applyInArrow(_fit, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32) if got else np.zeros(DIMENSIONS, np.float32)


def _scores(column, weights: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, data, offs in T.slices(column):
        bound, index, value = features(data, offs)
        rows = np.repeat(np.arange(len(offs) - 1), np.diff(bound))
        out.append(_sigmoid(np.bincount(rows, weights[index] * value, minlength=len(offs) - 1)))
    return np.concatenate(out)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``; a null text counts as empty, an empty one scores the constant.

    Texts are scored whole; equal texts score the same; other columns are ignored; no rows give no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), shared.value))], ["doc_id", "score"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; null counts as empty, repeated rows are each judged."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
