"""Byte strings that occur more than once, by a merge sort of suffixes that knows common prefixes.

Suffixes are sampled: a place counts if the ``gram`` bytes there have the smallest print in a window of ``window``
bytes. Equal windows have equal places, so a repeated window shows as two sampled suffixes that agree from the place
on, with equal bytes before it. Places whose gram occurs nowhere else are left out first.

Each task sorts its suffixes, front-codes them (length of the prefix shared with the one before, and the rest)
and sends each run to the block of its grams. A block combines its runs with a loser tree whose players remember how
many bytes they share with the last winner: known prefixes are never compared again. The order and the common
prefixes of neighbours say which windows agree to the right of the place; prints of the bytes on its left say the rest.
Suffixes with the same surroundings in one task are repeated for sure: one of them travels for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formgrain.llm import common

GRAM = 32
CHUNK = 1 << 20
SLICE_BYTES = 16 << 20
PLACES = np.uint64((1 << 24) - 1)
BYTE_CODES = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(common.MULTIPLIER))
NO_IDS = np.zeros(0, np.int64)


def sampled(text: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled places of a text: place, print of its gram, first and last start of the windows it stands for.

    A window's place is the last of the smallest grams in it. Long texts are read in chunks; a place may then come
    twice, for the windows of either chunk.
    """
    found = [(NO_IDS, NO_IDS.astype(np.uint64), NO_IDS, NO_IDS)]
    for at in range(0, len(text) - window + 1, CHUNK):
        codes = BYTE_CODES[np.frombuffer(text, np.uint8, min(len(text) - at, CHUNK + window - 1), at)]
        grams = common.rolling(codes, gram)
        ranked = (grams & ~PLACES) | (PLACES - np.arange(len(grams), dtype=np.uint64))
        place = (PLACES - (common.sliding_min(ranked, window - gram + 1) & PLACES)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        found.append((place[first] + at, grams[place[first]], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def gram_rows(batches: Iterator[pa.RecordBatch], window: int, gram: int, blocks: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, grams of places) and (-1 - share, places known to be repeated): a gram that a slice of documents
    has more than once travels once, marked."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids = common.row_ids(batch.column(0).to_pylist(), texts)
        for a, b in common.byte_slices(texts, SLICE_BYTES):
            each = [sampled(t, window, gram)[1] for t in texts[a:b]]
            prints = np.concatenate(each)
            if not len(prints):
                continue
            owner = np.repeat(ids[a:b], [len(x) for x in each])
            number = np.concatenate([np.arange(len(x)) for x in each])
            _, first, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
            many = counts[which] > 1
            rows = [(-1 - k, common.pack(*x)) for k, x in common.split_by(common.targets(owner[many], shares), owner[many], number[many])]
            block = (common.mixed(prints[first]) % np.uint64(blocks)).astype(np.int32)
            rows += [(k, common.pack(*x)) for k, x in common.split_by(block, prints[first], (counts > 1).astype(np.int8), owner[first], number[first].astype(np.int32))]
            yield common.key_batch(rows)


def repeated_grams(batches: Iterator[pa.RecordBatch], shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (share, places whose gram occurs elsewhere)."""
    for key, blobs in common.groups(batches):
        if key < 0:
            yield common.key_batch([(-1 - key, blob) for blob in blobs])
            continue
        prints, marks, owner, number = common.joined(blobs)
        _, which, counts = np.unique(prints, return_inverse=True, return_counts=True)
        told = (counts + np.bincount(which, marks, len(counts)) > 1)[which] & (marks == 0)
        yield common.key_batch([(k, common.pack(*x)) for k, x in common.split_by(common.targets(owner[told], shares), owner[told], number[told].astype(np.int64))])


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that two strings share from the start, ``known`` of which need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differ.bit_length() + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted strings as shared lengths, lengths of the rests, and all rests in one array."""
    shared = [0, *(shared_prefix(a, b) for a, b in pairwise(suffixes))] if suffixes else []
    rests = [s[n:] for s, n in zip(suffixes, shared, strict=True)]
    return np.array(shared, np.int32), np.array([len(r) for r in rests], np.int32), np.frombuffer(b"".join(rests), np.uint8)


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(run, bytes shared with the string before) of all strings of front-coded runs in sorted order, by a loser tree.

    A player is the next string of a run with the number of bytes it shares with the last winner. The player that
    shares more comes first; only if both share the same number are bytes compared, from there on.
    """
    k = 1 << max(1, (len(runs) - 1).bit_length())
    readers = [read_run(*run) for run in runs]
    end = (None, -1, -1)
    losers = [end] * k

    def play(a, b):
        """(winner, loser) of two players (string, shared, run)."""
        if a[0] is None or b[0] is None:
            return (b, a) if a[0] is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        s, t = a[0], b[0]
        n = shared_prefix(s, t, a[1])
        if n == len(s) or n < len(t) and s[n] < t[n]:
            return a, (t, n, b[2])
        return b, (s, n, a[2])

    level = []
    for r in range(k):
        player = next(readers[r], None) if r < len(runs) else None
        level.append((player[1], 0, r) if player else end)
    # The first strings meet in rounds; each inner node keeps the loser.
    width = k
    while width > 1:
        winners = []
        for m in range(width // 2):
            winner, losers[width // 2 + m] = play(level[2 * m], level[2 * m + 1])
            winners.append(winner)
        level, width = winners, width // 2
    winner = level[0]
    while winner[0] is not None:
        run = winner[2]
        yield run, winner[1]
        follows = next(readers[run], None)
        player = (follows[1], follows[0], run) if follows else end
        node = (run + k) // 2
        while node:
            player, losers[node] = play(player, losers[node])
            node //= 2
        winner = player


def read_run(shared: np.ndarray, lengths: np.ndarray, rests: np.ndarray) -> Iterator[tuple[int, bytes]]:
    data, at, before = rests.tobytes(), 0, b""
    for n, m in zip(shared.tolist(), lengths.tolist(), strict=True):
        before = before[:n] + data[at:at + m]
        at += m
        yield n, before


def suffix_runs(batches: Iterator[pa.RecordBatch], window: int, gram: int, blocks: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, front-coded run of suffixes) and (-1 - share, spans known already)."""
    held, numbers = None, {}
    for notes, ids, texts in common.noted_documents(batches):
        if notes is not held:
            held = notes
            owner, number = common.joined(notes) if notes else (NO_IDS, NO_IDS)
            numbers = {k: v[0] for k, v in common.split_by(owner, number)}
        owners, texts = common.row_ids(ids, texts), [t or b"" for t in texts]
        for a, b in common.byte_slices(texts, SLICE_BYTES):
            seen: dict[tuple[bytes, bytes], list[tuple[int, int, int, int, int]]] = {}
            for owner, text in zip(owners[a:b].tolist(), texts[a:b], strict=True):
                if owner not in numbers:
                    continue
                chosen = np.unique(numbers[owner])
                place, prints, first, last = (x[chosen].tolist() for x in sampled(text, window, gram))
                for p, g, f, e in zip(place, prints, first, last, strict=True):
                    seen.setdefault((text[p:e + window], text[f:p]), []).append((g, owner, p, f, e + window))
            if seen:
                yield common.key_batch(list(run_rows(seen, blocks, shares)))


def run_rows(seen: dict, blocks: int, shares: int) -> Iterator[tuple[int, bytes]]:
    again = np.array([x[1:] for found in seen.values() if len(found) > 1 for x in found], np.int64).reshape(-1, 4)
    for key, note in common.span_rows(again[:, 0], again[:, 2], again[:, 3], shares):
        yield -1 - key, note
    by_block: dict[int, list] = {}
    keys = sorted(seen)
    block = (common.mixed(np.array([seen[k][0][0] for k in keys], np.uint64)) % np.uint64(blocks)).tolist()
    for key, at in zip(keys, block, strict=True):
        by_block.setdefault(at, []).append(key)
    for at, own in by_block.items():
        firsts = [seen[k][0] for k in own]
        lefts = [left for _, left in own]
        yield at, common.pack(
            *front_coded([s for s, _ in own]), np.array([len(x) for x in lefts], np.int32), np.frombuffer(b"".join(lefts), np.uint8),
            np.array([x[1] for x in firsts], np.int64), np.array([x[2] for x in firsts], np.int64), np.array([len(s) for s, _ in own], np.int32))


def merged_blocks(batches: Iterator[pa.RecordBatch], window: int, gram: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (share, spans covered by repeated windows)."""
    for key, blobs in common.groups(batches):
        if key < 0:
            yield common.key_batch([(-1 - key, blob) for blob in blobs])
            continue
        runs = [common.unpack(blob) for blob in blobs]
        order = np.array(list(merged([run[:3] for run in runs])), np.int64).reshape(-1, 2)
        sizes = [len(run[5]) for run in runs]
        # The j-th winner of a run is its j-th string.
        at = np.empty(len(order), np.int64)
        at[np.argsort(order[:, 0], kind="stable")] = np.arange(sum(sizes))
        left_lengths, lefts, owner, place, right = (np.concatenate([run[c] for run in runs]) for c in range(3, 8))
        ends = np.cumsum(left_lengths.astype(np.int64))[at]
        hits = repeated_windows(order[:, 1], left_lengths[at].astype(np.int64), ends, lefts, right[at].astype(np.int64), window, gram)
        row, low, high = true_runs(hits)
        owner, place = owner[at], place[at]
        if len(row):
            yield common.key_batch(common.span_rows(owner[row], place[row] - high, place[row] - low + window, shares))


def repeated_windows(shared: np.ndarray, left: np.ndarray, left_end: np.ndarray, lefts: np.ndarray, right: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every suffix in sorted order and every d: does the window that starts d bytes before its place occur again?"""
    n = len(shared)
    hits = np.zeros((n, window - gram + 2), bool)
    with_next = np.r_[shared[1:], 0]
    closest = np.maximum(shared, with_next)
    prints = np.zeros(n, np.uint64)
    for d in range(window - gram + 1):
        if d:
            inside = np.flatnonzero(left >= d)
            if not len(inside):
                break
            prints[inside] = common.mixed(prints[inside] * np.uint64(common.MULTIPLIER) + BYTE_CODES[lefts[left_end[inside] - d]])
        able = np.flatnonzero((left >= d) & (right + d >= window) & (closest >= window - d))
        if len(able) < 2:
            continue
        alike = np.cumsum(shared < window - d).astype(np.uint64)
        both = common.mixed(prints[able] ^ common.mixed(alike[able]))
        _, which, counts = np.unique(both, return_inverse=True, return_counts=True)
        hits[able, d] = (counts > 1)[which]
    return hits


def true_runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of true values; the last column of ``hits`` is always false."""
    flat = np.r_[False, hits.ravel()]
    starts = np.flatnonzero(flat[1:] & ~flat[:-1])
    ends = np.flatnonzero(flat[:-1] & ~flat[1:]) - 1
    width = hits.shape[1]
    return starts // width, starts % width, ends % width


def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for spans, ids, texts in common.noted_spans(batches):
        out = []
        for doc_id, row, text in zip(ids, common.row_ids(ids, texts).tolist(), texts, strict=True):
            text = text or b""
            cut = spans.of(row)
            kept, at = [], 0
            for start, end in cut:
                kept.append(text[at:start])
                at = end
            kept = b"".join([*kept, text[at:]])
            out.append((doc_id, len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept, kept.decode("utf-8", "ignore")))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def repeated_bytes(documents: DataFrame, window: int = 200, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes left),
    kept_text (the same as text, without what a cut leaves of a character).

    A byte of the UTF-8 text is removed if a string of ``window`` bytes that covers it also starts anywhere else, in
    the same document or another. Null texts are empty. Repeated rows are documents of their own and so repeat each
    other; a row without doc_id is cut like any other. Other columns are ignored. An empty table gives an empty result.
    """
    if not 0 < gram <= window < 1 << 20:
        raise ValueError("gram must be between 1 and window")
    spark = documents.sparkSession
    common.on_workers(spark)
    n = common.partitions(spark)
    shares = blocks = 4 * n
    rows = "key int, note binary"
    texts = common.texts_of(documents)
    grams = texts.where("octet_length(text) >= " + str(window)).mapInArrow(lambda b: gram_rows(b, window, gram, blocks, shares), rows)
    places = common.by_key(grams, n).mapInArrow(lambda b: repeated_grams(b, shares), rows)
    runs = common.with_notes(texts, places, shares, n, by_row=True).mapInArrow(lambda b: suffix_runs(b, window, gram, blocks, shares), rows)
    spans = common.by_key(runs, n).mapInArrow(lambda b: merged_blocks(b, window, gram, shares), rows)
    return common.with_notes(texts, spans, shares, n, by_row=True).mapInArrow(
        cut_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string")
