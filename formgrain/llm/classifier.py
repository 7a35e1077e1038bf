"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are the hashed words and pairs of neighbouring words of a text (letters and signs apart), weighted by
1 + log(count) and scaled to length one; a score is the logistic of a sparse dot product. Training takes a bounded
sample of the labelled rows, dealt to a fixed number of learners that run in parallel; their weights are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common

WORDS = re.compile(r"\w+|[^\w\s]+").findall

DOUBLED = 2


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows taken (a bound, not a share); ``slots``: weights."""

    sample: int = 32_000
    learners: int = 8
    epochs: int = 3
    slots: int = 1 << 18
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-6


def features(text: str, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights of a text; the slot after the last is the offset."""
    codes = common.CODES.of(WORDS(text))
    pairs = codes[:-1] * np.uint64(common.MULTIPLIER) + codes[1:]
    # A pair of equal words also counts as that, whatever the word.
    doubled = np.full(int((codes[1:] == codes[:-1]).sum()), DOUBLED, np.uint64)
    hashed = (common.mixed(np.concatenate([codes, pairs, doubled])) % np.uint64(slots)).astype(np.int64)
    found, counts = np.unique(hashed, return_counts=True)
    values = 1 + np.log(counts)
    values /= max(1e-9, float(np.sqrt((values * values).sum())))
    return np.append(found, slots), np.append(values, 1.0)


def sample_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, label, order in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            at, values = features((text or b"").decode("utf-8", "replace"), s.slots)
            rows.append((order % s.learners, common.pack(np.array([order], np.int64), np.array([label], np.int8), np.array([len(at)], np.int64), at.astype(np.int32), values.astype(np.float32))))
        yield common.key_batch(rows)


def learned(batches: Iterator[pa.RecordBatch], s: Settings, offset: float) -> Iterator[pa.RecordBatch]:
    """One row for each learner: its weights after FTRL-proximal updates over its rows, in an order drawn by hash."""
    for key, blobs in common.groups(batches):
        order, labels, lengths, at, values = common.joined(blobs)
        ends = np.cumsum(lengths)
        z, n = np.zeros(s.slots), np.zeros(s.slots)

        def weights(i, z=z, n=n):
            zi = z[i]
            return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

        for epoch in range(s.epochs):
            for k in np.lexsort((common.mixed(order.astype(np.uint64) + np.uint64(epoch)),)):
                i, x = at[ends[k] - lengths[k]:ends[k] - 1], values[ends[k] - lengths[k]:ends[k] - 1]
                w = weights(i)
                g = (1 / (1 + np.exp(-(offset + w @ x))) - labels[k]) * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
        yield common.key_batch([(key, common.pack(weights(np.arange(s.slots)).astype(np.float32)))])


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from ``labels`` (doc_id, label 0 or 1), and last the offset, the log odds of a good label (kept between
    1:20 and 20:1), from which learning starts; without any label all are 0."""
    spark = documents.sparkSession
    common.on_workers(spark)
    s = settings
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").cast("byte").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1))
    known = known.withColumn("order", order)
    good, total = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    offset = float(np.clip(np.log((good + 0.5) / (total - good + 0.5)), -3, 3))
    if total > s.sample:
        # Slightly fewer than the bound, so that the drawn number stays under it.
        known = known.where(F.col("order") < int((1 << 40) * (s.sample - 3 * s.sample ** 0.5) / total))
    taken = F.broadcast(known) if s.sample <= 1_000_000 else known
    # Of several texts under one labelled id the smallest teaches, so the bound holds for rows as well as for labels.
    rows = common.texts_of(documents).join(taken, "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")).select("text", "label", "order")
    rows = rows.mapInArrow(lambda b: sample_rows(b, s), "key int, note binary")
    models = common.by_key(rows, s.learners).mapInArrow(lambda b: learned(b, s, offset), "key int, note binary").orderBy("key").collect()
    weights = np.mean([common.unpack(m.note)[0] for m in models], axis=0) if models else np.zeros(s.slots)
    return np.append(weights, offset).astype(np.float32)


def scored(batches: Iterator[pa.RecordBatch], weights, slots: int) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        scores = []
        for text in batch.column(1).to_pylist():
            at, values = features((text or b"").decode("utf-8", "replace"), slots)
            scores.append(1 / (1 + np.exp(-float(w[at] @ values))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    spark = documents.sparkSession
    common.on_workers(spark)
    held = spark.sparkContext.broadcast(weights)
    slots = len(weights) - 1
    return common.texts_of(documents).mapInArrow(lambda b: scored(b, held, slots), "doc_id long, score double")


def good_rows(batches: Iterator[pa.RecordBatch], weights, slots: int, cut: float) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        good = []
        for text in batch.column("text").to_pylist():
            at, values = features(text or "", slots)
            good.append(1 / (1 + np.exp(-float(w[at] @ values))) >= cut)
        yield batch.filter(pa.array(good, pa.bool_()))


def good_documents(documents: DataFrame, labels: DataFrame, cut: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose score is ``cut`` or more. No row moves."""
    spark = documents.sparkSession
    weights = train(documents, taught(labels), settings)
    held = spark.sparkContext.broadcast(weights)
    return documents.mapInArrow(lambda b: good_rows(b, held, len(weights) - 1, cut), documents.schema)


def taught(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold as (doc_id, label)."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out())


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows kept from training: crc32 of doc_id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, cut: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= ``cut``).

    ``labels``: doc_id and quality; rows in the held-out fold, without an id, or with a quality other than 0 and 1 teach
    nothing; an id labelled twice counts once, as 1 if either says so. Null and empty texts are scored by the offset
    alone. Without labels every score is 0.5. Repeated rows and null doc_ids are scored like any others (a null id is
    never held out); other columns are ignored; an empty table gives an empty result.
    """
    rows = score(documents, train(documents, taught(labels), settings))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
