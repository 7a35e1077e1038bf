"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a logistic classifier over hashed character n-grams tells languages
with a 1 from those with a 0. All bits are learned together, as columns of one table of weights. A text goes to the
language whose codeword has the least logistic loss against the bits' margins; if the runner-up is close, the text is
flagged as ambiguous. Features are the n-grams' shares of the text, so a text's margins are a mean over its places.
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

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
SCORED = "doc_id long, lang_pred string, score double, ambiguous boolean"
ORDERS = 40
#: Packed examples are sent on when they hold this many bytes.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """``sample``: about how many labelled rows are taken, shared equally by the languages (a bound, not a share);
    ``snippets``: word counts of the pieces that each of them is also learned from; ``close``: least difference of
    losses to the runner-up that is not ambiguous."""

    sample: int = 12_000
    learners: int = 8
    epochs: int = 2
    slots: int = 1 << 16
    longest: int = 3
    rate: float = 0.5
    snippets: tuple[int, ...] = (1, 3, 12)
    close: float = 0.5
    slice_chars: int = 1 << 16


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language. Up to 5 languages all ways to part them in two; for more, the bits of a hash,
    of several tries the one whose nearest rows differ most. No bit is the same for all languages."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        parts = np.arange(1, 1 << (languages - 1))
        return np.array([((parts >> k) & 1) * 2 - 1 for k in range(languages - 1)] + [-np.ones(len(parts))], np.int8)
    bits = 15 + 10 * int(np.ceil(np.log2(languages)))
    best = None
    for seed in range(32):
        code = np.random.default_rng(seed).integers(0, 2, (languages, bits)) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        nearest = (code.shape[1] - np.sort(code @ code.T, axis=1)[:, -2]) // 2
        if best is None or nearest.min() > best[0]:
            best = (nearest.min(), code)
    return best[1].astype(np.int8)


def letters_of(text: bytes | None) -> str:
    """Lower-case letters, with one space for whatever stands between them; empty if there is no letter."""
    line = NOT_LETTERS.sub(" ", (text or b"").decode("utf-8", "replace").lower()).strip()
    return f" {line} " if any(map(str.isalpha, line)) else ""


def grams(line: str, s: Settings) -> Iterator[np.ndarray]:
    """Slots of the n-grams that start at each place, some places at a time (slot 0 where an n-gram passes the end)."""
    shift = np.uint64(64 - (s.slots - 1).bit_length())
    for a in range(0, len(line), s.slice_chars):
        codes = np.frombuffer(line[a:a + s.slice_chars + s.longest - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        places = min(s.slice_chars, len(line) - a)
        out, joined = np.zeros((s.longest, places), np.int32), codes
        for n in range(1, s.longest + 1):
            if n > 1:
                joined = joined[:-1] * np.uint64(1_000_003) + codes[n - 1:]
            slots = ((joined + np.uint64(n)) * np.uint64(common.MULTIPLIER)) >> shift
            out[n - 1, :min(places, len(slots))] = slots[:places]
        yield out.ravel()


def example(line: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text and their shares of all its n-grams; the slot after the last is the offset."""
    if len(line) <= s.slice_chars:
        found, counts = np.unique(next(grams(line, s)), return_counts=True)
    else:
        every = sum(np.bincount(slots, minlength=s.slots) for slots in grams(line, s))
        found = np.flatnonzero(every)
        counts = every[found]
    return np.append(found, s.slots).astype(np.int32), np.append(counts / counts.sum(), 1.0).astype(np.float32)


def examples(line: str, order: int, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of a whole text and of snippets of few words, drawn by ``order``."""
    yield example(line, s)
    words = line.split()
    for k, size in enumerate(s.snippets):
        at = (order >> (8 * k)) % max(1, len(words) - size + 1)
        yield example(f" {' '.join(words[at:at + size])} ", s)


def example_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for text, label, order in zip(*batch.columns, strict=True):
            line, label, order = letters_of(text.as_py()), label.as_py(), order.as_py()
            for k, (at, values) in enumerate(examples(line, order, s) if line else ()):
                rows.append((order % s.learners, common.pack(np.array([order * 8 + k]), np.array([label], np.int32), np.array([len(at)]), at, values)))
                held += 8 * len(at)
            if held > BATCH_BYTES:
                yield common.key_batch(rows)
                rows, held = [], 0
        yield common.key_batch(rows)


def learned(batches: Iterator[pa.RecordBatch], code: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    """One row per learner: the sum of its weights over its updates' ends, by steps scaled to each weight's past gradients."""
    bits = code.shape[1]
    for key, blobs in common.groups(batches):
        order, labels, lengths, at, values = common.joined(blobs)
        ends = np.cumsum(lengths)
        w, past = np.zeros((s.slots + 1, bits), np.float32), np.full((s.slots + 1, bits), 1e-8, np.float32)
        for epoch in range(s.epochs):
            for k in np.lexsort((common.mixed(order.astype(np.uint64) + np.uint64(epoch)),)).tolist():
                i, x = at[ends[k] - lengths[k]:ends[k]], values[ends[k] - lengths[k]:ends[k]]
                y = code[labels[k]]
                slope = -y / (1 + np.exp(y * (x @ w[i])))
                step = x[:, None] * slope
                past[i] += step * step
                w[i] -= s.rate * step / np.sqrt(past[i])
        yield common.key_batch([(key, common.pack(w.ravel()))])


@dataclass(frozen=True)
class Model:
    """Learned languages (sorted), their codewords and the weights: a row per slot, the last one the offset."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray


def train(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """Codes and bit classifiers from the rows of ``documents`` (text, lang) whose lang is not null."""
    s, spark = settings, documents.sparkSession
    common.on_workers(spark)
    order = F.xxhash64("doc_id", "text", F.lit(13)).bitwiseAND(F.lit((1 << ORDERS) - 1))
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), order.alias("order"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    if not languages:
        return Model((), code, np.zeros((s.slots + 1, 1), np.float32))
    share = s.sample / len(languages)
    taken = [(lang, k, int((1 << ORDERS) * min(1.0, share / counts[lang]))) for k, lang in enumerate(languages)]
    table = spark.createDataFrame(taken, "lang string, label int, below long")
    drawn = rows.join(F.broadcast(table), "lang").where(F.col("order") < F.col("below")).select("text", "label", "order")
    packed = drawn.mapInArrow(lambda b: example_rows(b, s), "key int, note binary")
    models = common.by_key(packed, s.learners).mapInArrow(lambda b: learned(b, code, s), "key int, note binary").orderBy("key").collect()
    weights = sum((common.unpack(m.note)[0] for m in models), np.zeros((s.slots + 1) * code.shape[1], np.float32))
    return Model(tuple(languages), code, weights.reshape(s.slots + 1, -1) / max(1, len(models)))


def margins(lines: list[str], weights: np.ndarray, s: Settings) -> np.ndarray:
    """Margins of all bits of each text, from all of its places."""
    out = np.zeros((len(lines), weights.shape[1]))
    for k, line in enumerate(lines):
        for slots in grams(line, s):
            out[k] += np.ones(len(slots), np.float32) @ weights[slots]
        out[k] = out[k] / (s.longest * len(line)) + weights[-1]
    return out


def decoded(margin: np.ndarray, code: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword of each row by logistic loss, its share of all codewords' likelihoods, and whether another is close."""
    losses = np.logaddexp(0, -margin[:, np.newaxis, :] * code).sum(axis=2)
    best = losses.argmin(axis=1)
    least = losses[np.arange(len(best)), best]
    shares = 1 / np.exp(least[:, np.newaxis] - losses).sum(axis=1)
    second = np.partition(losses, 1, axis=1)[:, 1] if code.shape[0] > 1 else np.full(len(best), np.inf)
    return best, shares, second - least < close


def identified(batches: Iterator[pa.RecordBatch], held, s: Settings) -> Iterator[pa.RecordBatch]:
    model = held.value
    for batch in batches:
        lines = [letters_of(t.as_py()) for t in batch.column(1)]
        known = np.array([bool(line) and bool(model.languages) for line in lines], bool)
        names, scores, unclear = np.full(len(lines), UNKNOWN, object), np.zeros(len(lines)), np.ones(len(lines), bool)
        if known.any():
            best, shares, close = decoded(margins([line for line, k in zip(lines, known, strict=True) if k], model.weights, s), model.code, s.close)
            names[known], scores[known], unclear[known] = np.array(model.languages, object)[best], np.minimum(shares, 1.0), close
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(unclear)], names=["doc_id", "lang_pred", "score", "ambiguous"])


def identify(documents: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of ``documents`` (doc_id, text); no row moves."""
    common.on_workers(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)
    return common.texts_of(documents).mapInArrow(lambda b: identified(b, held, settings), SCORED)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Rows kept from training: crc32 of doc_id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def languages(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous.

    Learns from rows outside the held-out fold whose lang and text are not null. ``und``, with score 0 and flagged as
    ambiguous, is returned for null texts, for texts without a letter, and for all if there is no lang to learn from;
    with one lang only, every other text gets it. Null doc_ids are never held out; repeated rows are told alike;
    languages with equal loss go to the first by name; other columns are ignored; an empty table gives an empty result.
    """
    model = train(documents.where(~held_out()), settings)
    return identify(documents, model, settings).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
