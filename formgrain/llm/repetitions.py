"""Periodic runs of words: a dictionary of basic factors names all stretches of 1, 2, 4, ... words of a text.

Equal stretches of one length have equal names, found by naming pairs of names of half the length. For each length from
8 on, the next place with the same name, if it is no farther than twice the length, proposes its distance as a period;
neighbouring places with one distance are one proposal (in a run they form arithmetic progressions, one for each
remainder). Proposals are extended to both sides by descending through the names, and equal ones are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common

#: A run has at least this many words and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Shortest factor that proposes: a run of period q <= 8 has 24 words, so it holds a factor of 8 words and its successor.
SHORTEST = 8
#: Documents in a batch of results; texts of a batch are closed when they hold this many bytes.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("longest", RUN), ("collapsed", pa.binary())])
SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "longest struct<start: long, length: long, period: long>, collapsed binary"
)
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def basic_factors(words: list[bytes]) -> list[np.ndarray]:
    """names[k][i] names words i to i + 2**k; lengths end where no stretch recurs, or where none could propose."""
    codes: dict[bytes, int] = {}
    names = [np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))]
    if len(codes) == len(words):
        return names
    width = 1
    while len(words) >= max(LEAST_WORDS, 3 * width):
        last = names[-1]
        pairs = last[:-width] * (len(words) + 1) + last[width:]
        found, named = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            break
        names.append(named)
        width *= 2
    return names


def successors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that have a later place with the same name, in rising order, and the distance to the next such place."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    at, far = order[:-1][same], (order[1:] - order[:-1])[same]
    back = np.argsort(at)
    return at[back], far[back]


def agreement(names: list[np.ndarray], a: np.ndarray, far: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``a`` on (or before ``a``) equal those ``far`` behind them."""
    n, moved, top = len(names[0]), np.zeros(len(a), np.int64), len(names) - 1
    for k in range(top, -1, -1):
        width, active = 1 << k, np.ones(len(a), bool)
        while active.any():
            at = a + moved if forward else a - moved - width
            active &= (at >= 0) & (at + far + width <= n)
            active &= names[k][np.where(active, at, 0)] == names[k][np.where(active, at + far, 0)]
            moved[active] += width
            # Only the longest factor can fit more than once in a row.
            if k < top:
                break
    return moved


def runs_of(words: list[bytes]) -> np.ndarray:
    """All runs as rows (start, length, period), by start, then period."""
    empty = np.zeros((0, 3), np.int64)
    if len(words) < LEAST_WORDS:
        return empty
    names = basic_factors(words)
    found = []
    for k in range(SHORTEST.bit_length() - 1, len(names)):
        width = 1 << k
        at, far = successors(names[k])
        near = far <= 2 * width
        at, far = at[near], far[near]
        if not len(at):
            continue
        cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])])
        first, last, period = at[cuts], at[np.r_[cuts[1:], len(at)] - 1], far[cuts]
        start = first - agreement(names, first, period, False)
        end = last + width + agreement(names, last + width, period, True) + period
        found.append(np.stack([start, end - start, period], axis=1))
    if not found:
        return empty
    rows = np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    return rows[rows[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * rows[:, 2])]


def most_repeated(runs: list[list[int]]) -> list[int] | None:
    """The run with the greatest exact length / period; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def struct(run: list[int] | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run, strict=True))


def found_runs(batches: Iterator[pa.RecordBatch], prepare: Prepare | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            # bytes.split() without an argument splits at exactly space and \x09 to \x0D.
            doc_id, words = doc_id.as_py(), (text.as_py() or b"").split()
            if prepare:
                words = prepare(doc_id, words)
            runs = runs_of(words)
            collapsed = b" ".join(kept_words(words, runs))
            listed = runs.tolist()
            rows.append((doc_id, len(words), [struct(r) for r in listed], struct(most_repeated(listed)), collapsed))
            held += len(collapsed) + 48 * len(listed)
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


def periodic_runs(documents: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, runs (all, by start, then period), longest (most periods), collapsed.

    A run is a stretch of words with smallest period q, at least max(24, 3 q) words long, that no neighbour extends;
    collapsed is the text without the words of a run after its first period, joined by one space. ``prepare`` may
    change the words of a document (doc_id, words) before. No row moves and nothing is kept between rows.

    A null, empty or blank text has no words: no runs, longest null, collapsed empty. Repeated rows and null doc_ids
    are treated like any others; of runs with equally many periods longest is the first, then the one of the smaller
    period; other columns are ignored; an empty table gives an empty result. A text of n words takes n numbers for each
    factor length up to the longest that recurs.
    """
    common.on_workers(documents.sparkSession)
    rows = common.texts_of(documents).mapInArrow(lambda b: found_runs(b, prepare), SCHEMA)
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten, picked by crc32 of its doc_id, repeat from a place and with a period that follow from it."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(documents: DataFrame) -> DataFrame:
    """The runs of ``documents`` after ``looped``, as figures and digests: doc_id, n_runs, start, length, period,
    exponent_milli (null without a run), runs_sha256, collapsed_sha256."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    best = F.col("longest")
    return periodic_runs(documents, looped).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
