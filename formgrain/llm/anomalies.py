"""Quality rules: an isolation forest over rule statistics.

Every document gets the statistics of the rules (words, characters, symbols, repeated lines and windows, case and
punctuation). A forest of random splits, grown on bounded subsamples as the method asks, gives each document its
mean path length; short paths are anomalies. The threshold between normal and anomalous is set from a histogram of
all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common

#: The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punctuation", "n_lines")
NOT_WORD = bytes([0x20, *range(0x09, 0x0E)])
CONTINUED = bytes(range(0x80, 0xC0))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_PUNCTUATION = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126))
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
BINS = 1000


@dataclass(frozen=True)
class Settings:
    """``clean_kept``: least share of the good labelled rows that the threshold keeps."""

    trees: int = 100
    subsample: int = 256
    clean_kept: float = 0.99
    default_threshold: float = 0.65
    seed: int = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    prints = common.rolling(common.CODES.of(words), window)
    if not len(prints):
        return 0
    order = np.argsort(prints, kind="stable")
    same = prints[order][1:] == prints[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    starts[twice] += 1
    np.subtract.at(starts, twice + window, 1)
    return int((np.cumsum(starts)[:len(words)] > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.translate(None, NOT_WORD)]
    return len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    solid = text.translate(None, NOT_WORD)
    return (
        len(words), len(solid.translate(None, CONTINUED)), len(text.translate(None, NOT_SYMBOL)), repeated_lines(text),
        repeated_words(words), len(text.translate(None, NOT_UPPER)), len(text.translate(None, NOT_PUNCTUATION)), text.count(b"\n") + 1,
    )


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t or b"") for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(rows.shape[1]))], names=["doc_id", *STATISTICS])


def rule_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    common.on_workers(documents.sparkSession)
    return common.texts_of(documents).mapInArrow(measured, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))


def points(rows: np.ndarray) -> np.ndarray:
    """Statistics as features: lengths on a log scale, all else as shares."""
    words, chars, symbols, dup, repeat, upper, marks, lines = (rows[:, k].astype(float) for k in range(8))
    of = lambda a, b: a / np.maximum(b, 1)
    return np.stack([np.log1p(words), of(chars, words), of(symbols, chars), of(dup, lines), of(repeat, words), of(upper, chars), of(marks, chars)], axis=1)


def path_bonus(n: np.ndarray) -> np.ndarray:
    """Mean path length of a search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as arrays: a node's feature (-1 in a leaf), split, first child (the second follows), leaf depth."""

    def __init__(self, rows: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.depth = max(1, int(np.ceil(np.log2(max(2, s.subsample)))))
        self.size = min(s.subsample, len(rows))
        for _ in range(s.trees if len(rows) else 0):
            self.trees.append(self.grown(rows[rng.choice(len(rows), self.size, replace=False)], rng))

    def grown(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, split, child, depth = [-1], [0.0], [0], [0.0]
        open_nodes = [(0, rows, 0)]
        while open_nodes:
            node, rows, level = open_nodes.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == self.depth or len(rows) < 2 or not len(wide):
                depth[node] = level + float(path_bonus(len(rows)))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(low[f], high[f])
            left = rows[:, f] < at
            if left.all() or not left.any():
                left = rows[:, f] <= low[f]
                at = np.nextafter(low[f], np.inf)
            feature[node], split[node], child[node] = f, at, len(feature)
            for part in (rows[left], rows[~left]):
                feature.append(-1), split.append(0.0), child.append(0), depth.append(0.0)
                open_nodes.append((len(feature) - 1, part, level + 1))
        return np.array(feature), np.array(split), np.array(child), np.array(depth)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path, the higher."""
        if not self.trees:
            return np.zeros(len(x))
        total, each = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, depth in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, child[node] + (x[each, np.maximum(f, 0)] >= split[node]))
            total += depth[node]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(path_bonus(self.size))))


def isolated(batches: Iterator[pa.RecordBatch], forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([np.asarray(batch.column(k)) for k in range(1, 1 + len(STATISTICS))], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.scores(points(rows)))], names=[*batch.schema.names, "anomaly"])


def threshold(scores: DataFrame, labels: DataFrame, s: Settings) -> float:
    """The score from which a document is anomalous: best at telling the labelled rows apart, among the thresholds
    that keep at least ``clean_kept`` of the good ones. Rows are counted in 1000 bins; without bad or good rows the
    default holds."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    bins = scores.join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count().collect()
    counts = np.zeros((2, BINS + 2))
    for r in bins:
        counts[r.quality, r.bin] += r["count"]
    if not counts.sum(axis=1).all():
        return s.default_threshold
    below = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
    gain = np.where(below[1] >= s.clean_kept, below[1] - below[0], -1)
    return float((int(np.argmax(gain)) + 1) / BINS)


def quality_rules(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept.

    base_failed: fewer than 20 words, or over 30 of 100 words in windows of 8 words that recur in the text. kept: not
    base_failed, and the anomaly score is under the threshold. A null text has no words and fails. Repeated rows and
    null doc_ids are judged like any others; an id labelled both ways counts both ways; other columns are ignored; an
    empty table gives an empty result; without labels of both kinds a fixed threshold holds.
    The forest takes trees x subsample rows, drawn by hash, whatever the table's size.
    """
    s = settings
    spark = documents.sparkSession
    stats = common.stored(rule_statistics(documents), "rule-statistics")
    need = s.trees * s.subsample
    few = stats.sample(min(1.0, 2 * need / max(1, stats.count())), s.seed)
    drawn = few.orderBy(F.xxhash64("doc_id", F.lit(s.seed)), *STATISTICS).limit(need).select(*STATISTICS).collect()
    forest = spark.sparkContext.broadcast(Forest(points(np.array([tuple(r) for r in drawn], np.int64).reshape(-1, len(STATISTICS))), s))
    schema = ", ".join(f"{c} long" for c in ("doc_id", *STATISTICS)) + ", anomaly double"
    scores = common.stored(stats.mapInArrow(lambda b: isolated(b, forest), schema), "anomaly-scores")
    cut = threshold(scores, labels, s)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scores.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "anomaly",
        (~failed & (F.col("anomaly") < cut)).alias("kept"))
