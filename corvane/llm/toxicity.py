"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut
from corvane.llm.grams import Distinct, code_points, gram_hashes

SIZES, BITS = (5, 6), 20
#: Labelled rows of each class that the linear weights are fitted on, at most (expected); the log-count ratios count all labelled rows.
FIT_TOXIC, FIT_CLEAN = 4_000, 8_000
#: Bytes of telling grams (4 each) that the driver fits on, at most (expected); where the rows have more, a share of them is chosen by hash.
FIT_BYTES = 64 << 20
#: Grams in fewer labelled documents, or with a smaller ratio either way, have ratio 0.
LEAST_DOCS, LEAST_RATIO = 10, 1.0
#: Passes of the fit, its step size, its ridge, and how much more a toxic row weighs.
ROUNDS, RATE, RIDGE, TOXIC_WEIGHT = 60, 0.05, 1.0, 8.0
#: Labels that may be broadcast to the scan; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
_BLOCKS = 64


def features(text: str | None, distinct: Distinct) -> np.ndarray:
    """Distinct hashed n-grams of the whole lower-case text; white space and control characters are spaces."""
    points = np.maximum(code_points((text or "").lower()), 32)
    return distinct(np.concatenate(gram_hashes(points, SIZES, BITS))) if len(points) >= SIZES[0] else np.zeros(0, np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # of a gram's presence: linear weight times log-count ratio
    bias: float

    def score(self, grams: np.ndarray) -> float:
        z = float(self.weights[grams].sum(dtype=np.float64)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic, fit) rows: at the end per-class document counts in blocks, on the way the grams of the rows to fit."""
    distinct, counts, n = Distinct(BITS), np.zeros((2, 1 << BITS), np.int32), [0, 0]

    def rows(block: int, toxic: int, data: bytes, total: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([toxic], pa.int32()), pa.array([data], pa.binary()), pa.array([total], pa.int64())], ["block", "toxic", "data", "n"])

    for batch in batches:
        for text, toxic, fit in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            grams = features(text.as_py(), distinct)
            counts[toxic, grams] += 1
            n[toxic] += 1
            if fit:
                yield rows(-1, toxic, grams.tobytes(), 1)
    if sum(n):
        for toxic in (0, 1):
            for block, part in enumerate(np.split(counts[toxic], _BLOCKS)):
                yield rows(block, toxic, part.tobytes(), n[toxic])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in pdf["data"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "toxic": pdf["toxic"].iloc[:1], "data": [total.tobytes()], "n": [int(pdf["n"].sum())]})


def fit(grams: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray, prior: float) -> Model:
    """Weighted logistic regression on presence * ratio, full-batch with per-weight step sizes."""
    kept = [g[ratio[g] != 0] for g in grams]
    lengths = np.array([len(g) for g in kept])
    ids = np.concatenate([*kept, np.zeros(0, np.uint32)]).astype(np.int64)
    used, at = np.unique(ids, return_inverse=True)
    r = ratio[used].astype(np.float32)
    row = np.repeat(np.arange(len(kept)), lengths)
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weight = weight / weight.sum()
    x = r[at]
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[at] * x, minlength=len(kept)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * weight
        g = np.append(np.bincount(at, weights=error[row] * x, minlength=len(used)) + RIDGE * w / max(1, len(used)) ** 0.5, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * r
    return Model(weights, bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (id, text) joined with ``labels`` (id, toxic); rows held out are not read."""
    known = labels.filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known, "toxicity-labels")
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        flat = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(flat / (1 - flat))))
    share = {0: min(1.0, FIT_CLEAN / n[0]), 1: min(1.0, FIT_TOXIC / n[1])}
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, share[1] * (1 << 20)).otherwise(share[0] * (1 << 20))
    known = known.withColumn("fit", chosen)
    known = F.broadcast(known) if sum(n.values()) <= BROADCAST_LABELS else known
    labelled = docs.join(known, "id").select("text", "toxic", "fit")
    found = cut(labelled.mapInArrow(_gather, "block int, toxic int, data binary, n long"), "toxicity-counts")
    counts, total = np.zeros((2, 1 << BITS)), [0, 0]
    width = (1 << BITS) // _BLOCKS
    for r in found.filter("block >= 0").groupBy("block", "toxic").applyInPandas(_added, found.schema).collect():
        counts[r.toxic, r.block * width : (r.block + 1) * width] = np.frombuffer(r.data, np.int64)
        total[r.toxic] = r.n
    if not total[0] or not total[1]:
        flat = (total[1] + 0.5) / (sum(total) + 1)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(flat / (1 - flat))))
    ratio = np.log((counts[1] + 1) / (total[1] + 2)) - np.log((counts[0] + 1) / (total[0] + 2))
    ratio[(counts.sum(0) < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    telling = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, np.uint32) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([g[telling.value[g]].tobytes() for g in grams], pa.binary())], ["toxic", "data"])

    sample = cut(found.filter("block < 0").select("toxic", "data").mapInArrow(told, "toxic int, data binary"), "toxicity-sample")
    size = sample.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    chosen = F.pmod(F.xxhash64("data"), F.lit(1 << 20)) < FIT_BYTES / max(1, size) * (1 << 20)
    sample = (sample.filter(chosen) if size > FIT_BYTES else sample).toArrow()
    toxic = sample.column("toxic").to_numpy()
    weight = np.where(toxic == 1, TOXIC_WEIGHT / share[1], 1 / share[0])
    return fit([np.frombuffer(x.as_buffer(), np.uint32) for x in sample.column("data")], toxic, weight, ratio, total[1] / sum(total))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: id_col, held_out, score, predicted.

    Learns from labelled rows whose crc32(id) mod 5 is not 0; ratios count all of them, the
    linear weights are fitted on a bounded share chosen by hash.  Scores depend on the whole text alone.
    Null, empty and very short texts have no n-grams and get the score of the bias.
    Null ids are not held out and have no label; labels other than 0 and 1 are dropped, and of
    several labels the highest counts.  Without labels of both classes every score is the smoothed share.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    model = train(rows, labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, score = Distinct(BITS), held.value.score
        for batch in batches:
            found = pa.array([score(features(x.as_py(), distinct)) for x in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "held_out", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", held_out(F.col("id")).alias("held_out"), "text").mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
