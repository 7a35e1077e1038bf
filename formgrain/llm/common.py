"""Helpers shared by the operators: word codes, rolling prints, packed arrays, documents joined with notes on them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.session import remove_dir, shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
MULTIPLIER = 0x9E3779B97F4A7C15
CACHED_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (clusters have it installed or in --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which its user sets by the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    for made in _MADE:
        made.append(path)
    df.write.mode("overwrite").parquet(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.stored_at = path
    return table_


#: Folders written since each open ``scratch``.
_MADE: list[list[str]] = []


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for a table that nothing reads any more."""
    remove_dir(df.sparkSession, df.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are removed at the end, on errors too, but for those handed to the function it gives."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    _MADE.append(made)
    try:
        yield keep
    finally:
        _MADE.remove(made)
        for path in made:
            if path not in kept:
                remove_dir(spark, path)


def row_key():
    """A column that tells rows of documents apart by doc_id and text together; equal rows have the same. It is the same
    in every pass over a table, and unlike the doc_id it is never null."""
    text = F.col("text").cast("string").cast("binary")
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(text, F.lit(b"")), text.isNull())


def texts_of(documents: DataFrame) -> DataFrame:
    """doc_id (long) and text as UTF-8 bytes; all other columns are left out, whatever they are called."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


class Codes(dict):
    """64-bit code of a word; the first CACHED_WORDS different ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


CODES = Codes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits spread over the whole 64-bit value (a bijection)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Print of every run of ``width`` codes, by joining prints of runs of 1, 2, 4, ... codes."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    out, out_len, part, part_len = None, 0, codes, 1
    while True:
        if width & part_len:
            if out is None:
                out = part
            else:
                n = len(codes) - out_len - part_len + 1
                out = out[:n] * np.uint64(pow(MULTIPLIER, part_len, 1 << 64)) + part[out_len:out_len + n]
            out_len += part_len
        if out_len == width:
            return mixed(out)
        n = len(part) - part_len
        part = part[:n] * np.uint64(pow(MULTIPLIER, part_len, 1 << 64)) + part[part_len:part_len + n]
        part_len *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:len(values) - step], values[step:])
        done += step
    return values


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value; ``unpack`` reads them back."""
    head = b"".join(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") for a in arrays)
    return bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 1 + 12 * blob[0], []
    for k in range(blob[0]):
        kind = np.dtype(blob[1 + 12 * k:5 + 12 * k].decode().strip())
        n = int.from_bytes(blob[5 + 12 * k:13 + 12 * k], "little")
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


def joined(blobs: list[bytes]) -> list[np.ndarray]:
    """The k-th arrays of all blobs, each joined to one."""
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def split_by(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows with equal keys together: (key, columns)."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
        yield int(keys[a]), [c[a:b] for c in columns]


def byte_slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` bytes together; a longer text stands alone."""
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by their first column."""
    return batch.take(pa.array(np.argsort(np.asarray(batch.column(0)), kind="stable")))


def targets(doc_ids: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` shares of the documents an id belongs to."""
    return (mixed(doc_ids.astype(np.uint64)) % np.uint64(n)).astype(np.int32)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(key, blobs) from rows (key, blob) that are sorted by key."""
    key, blobs = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key and blobs:
                yield key, blobs
                blobs = []
            key = k
            blobs.append(blob)
    if blobs:
        yield key, blobs


def by_key(rows: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Rows of a key together, in ``n`` partitions."""
    return rows.repartition(n, key).sortWithinPartitions(key)


def small(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, for the way through an exchange."""
    pack_ = zstandard.ZstdCompressor(level=1).compress
    return pa.array([None if t is None else pack_(t) for t in texts.to_pylist()], pa.binary())


def row_ids(ids: list, texts: list) -> np.ndarray:
    """One number for a row's id and text together; equal rows have the same."""
    return np.array([xxhash.xxh3_64_intdigest(t or b"", (0 if i is None else i + 1) % (1 << 64)) for i, t in zip(ids, texts, strict=True)], np.uint64).astype(np.int64)


def share_documents(batches: Iterator[pa.RecordBatch], shares: int, by_row: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        known = row_ids(ids.to_pylist(), batch.column(1).to_pylist()) if by_row else np.asarray(ids.fill_null(0)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(targets(known, shares)), pa.array(np.ones(len(batch), np.int8)), ids, small(batch.column(1)), pa.nulls(len(batch), pa.binary())],
            names=["key", "kind", "doc_id", "text", "note"],
        )


def with_notes(documents: DataFrame, notes: DataFrame, shares: int, n: int, by_row: bool = False) -> DataFrame:
    """Documents (doc_id, text) and notes on them (key, note), both dealt by the document's share, notes first.
    The share follows from the doc_id, or with ``by_row`` from ``row_ids``.

    One exchange brings a text to the notes of its share, so that no row is made per document and note.
    """
    dealt = documents.mapInArrow(lambda b: share_documents(b, shares, by_row), "key int, kind byte, doc_id long, text binary, note binary")
    noted = notes.select("key", F.lit(0).cast("byte").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "note")
    return dealt.unionByName(noted).repartition(n, "key").sortWithinPartitions("key", "kind")


def noted_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list, list]]:
    """(notes of a share, doc_ids, texts) from the rows of ``with_notes``; the documents of a share come in one or more parts."""
    key, notes = None, []
    full = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keys, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])]) if len(keys) else []
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if keys[a] != key:
                key, notes = keys[a], []
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                notes += part.column(4).to_pylist()
            else:
                texts = [None if t is None else full(t) for t in part.column(3).to_pylist()]
                yield notes, part.column(2).to_pylist(), texts


class Spans:
    """Spans (doc_id, start, end) of a share, looked up by document."""

    def __init__(self, notes: list[bytes]):
        ids, starts, ends = joined(notes) if notes else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((starts, ids))
        self.ids, self.starts, self.ends = ids[order], starts[order], ends[order]

    def of(self, doc_id: int | None) -> list[tuple[int, int]]:
        """Disjoint, growing spans of a document: overlapping and touching ones are joined."""
        if doc_id is None:
            return []
        a, b = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        out: list[tuple[int, int]] = []
        for start, end in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out


def noted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Spans, list, list]]:
    held, spans = None, None
    for notes, ids, texts in noted_documents(batches):
        if notes is not held:
            held, spans = notes, Spans(notes)
        yield spans, ids, texts


def span_rows(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, shares: int) -> list[tuple[int, bytes]]:
    return [
        (key, pack(*columns))
        for key, columns in split_by(targets(ids, shares), ids.astype(np.int64), starts.astype(np.int64), ends.astype(np.int64))
    ]


def key_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["key", "note"])
