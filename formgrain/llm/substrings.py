"""Passages repeated from earlier documents, by relative Lempel-Ziv parsing against reference blocks.

The letters of the parse are prints of ``window`` consecutive words. A print is dealt to a block by the smallest
``gram``-word print inside its window, so equal windows always meet in one block, and neighbouring windows mostly
travel together. A block indexes all of its runs in reading order (doc_id, then position) by the order of their suffixes; every
run is factored greedily, left to right, into the longest pieces that start earlier in the block. A factor of m letters
is a repeated passage of m + window - 1 words, so the shortest one, of one letter, is as long as a passage must be.
Where a factor ends, the letter at its boundary is looked up afresh: it starts the next factor, or, if it occurs nowhere
earlier, stands between factors; so no window is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from formgrain.llm import common

GRAM = 5
SLICE_BYTES = 6 << 20


def runs(prints: np.ndarray, owners: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of kept letters with one owner."""
    if not len(prints):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = keep[1:] & keep[:-1] & (owners[1:] == owners[:-1])
    starts = np.flatnonzero(keep & np.r_[True, ~same])
    ends = np.flatnonzero(keep & np.r_[~same, True]) + 1
    return starts, ends


def firsts(prints: np.ndarray) -> np.ndarray:
    """For each letter, where it occurs first."""
    _, first, which = np.unique(prints, return_index=True, return_inverse=True)
    return first[which]


def suffix_order(prints: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letters by what follows from them on, up to the ends of their runs; equal ones by index. Ranks of 1, 2, 4, ...
    letters are joined until no more letters are told apart."""
    _, rank = np.unique(prints, return_inverse=True)
    n, width, here = len(prints), 1, np.arange(len(prints))
    rank, distinct = rank.astype(np.int64) + 1, 0
    while True:
        there = here + width
        second = np.where(there < ends, rank[np.minimum(there, n - 1)], 0)
        found, rank = np.unique(rank * (n + 2) + second, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if len(found) in (distinct, n):
            return np.argsort(rank, kind="stable")
        width, distinct = 2 * width, len(found)


def neighbours(order: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each letter the nearest one before it and after it in suffix order that has an earlier place, or -1. One of the
    two starts the longest match among all letters with earlier places."""
    before, after = np.full(len(order), -1), np.full(len(order), -1)
    for out, way in ((before, order.tolist()), (after, order[::-1].tolist())):
        held: list[int] = []
        place = places.tolist()
        for k in way:
            while held and place[held[-1]] >= place[k]:
                held.pop()
            if held:
                out[k] = held[-1]
            held.append(k)
    return before, after


def matching(prints: np.ndarray, a: int, b: int, most: int) -> int:
    """How many letters from ``a`` on equal those from ``b`` on."""
    done, step = 0, 32
    while done < most:
        size = min(step, most - done)
        differ = np.flatnonzero(prints[a + done:a + done + size] != prints[b + done:b + done + size])
        if len(differ):
            return done + int(differ[0])
        done, step = done + size, 2 * step
    return done


def numbered(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places (document, position) as numbers in reading order; equal places have one number."""
    order = np.lexsort((at, ids))
    new = np.r_[False, (ids[order[1:]] != ids[order[:-1]]) | (at[order[1:]] != at[order[:-1]])] if len(ids) else np.zeros(0, bool)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def factors(prints: np.ndarray, places: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and sources of the greedy factors: at each letter that occurs at an earlier place, the longest piece of
    its run that starts at any earlier place; then on from the piece's end.

    ``places``: as of ``numbered``; ``linked``: the letter continues the one before it in the same document.
    """
    _, which, counts = np.unique(prints, return_inverse=True, return_counts=True)
    # Letters that occur once are in no factor and no source.
    some = np.flatnonzero(counts[which] > 1)
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    prints, places = prints[some], places[some]
    begins = np.r_[True, ~(linked[some[1:]] & (np.diff(some) == 1))]
    ends = np.append(np.flatnonzero(begins)[1:], len(some))[np.cumsum(begins) - 1]
    before, after = neighbours(suffix_order(prints, ends), places)
    sources = np.stack([before, after], axis=1)
    # A neighbour in suffix order need not share a letter.
    sources = np.where(prints[sources] == prints[:, None], sources, -1)
    starts, stops, origins = [], [], []
    at = 0
    known = np.flatnonzero((sources >= 0).any(axis=1))
    while True:
        k = np.searchsorted(known, at)
        if k == len(known):
            break
        at = int(known[k])
        most = int(ends[at]) - at
        length, origin = max((matching(prints, at, a, min(most, int(ends[a]) - a)), -a) for a in sources[at].tolist() if a >= 0)
        starts.append(at)
        stops.append(at + length)
        origins.append(-origin)
        at += length
    first, last = np.array(starts, np.int64), np.array(stops, np.int64)
    return some[first], some[last - 1] + 1, some[np.array(origins, np.int64)]


def earlier(prints: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Index of an equal letter at an earlier (doc_id, position), or -1; letters stand in that order."""
    first = firsts(prints)
    own = (ids[first] == ids) & (places[first] == places)
    return np.where(own, -1, first)


def letters(ids: np.ndarray, texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Prints of all windows with document, position and block key, in reading order."""
    words = [text.split() for text in texts]
    counts = np.array([len(w) for w in words], np.int64)
    codes = common.CODES.of([x for w in words for x in w])
    ends = np.cumsum(counts)
    if len(codes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prints = common.rolling(codes, window)
    smallest = common.sliding_min(common.rolling(codes, gram), window - gram + 1)
    row = np.repeat(np.arange(len(ids)), counts)[:len(prints)]
    place = np.arange(len(prints)) - (ends - counts)[row]
    whole = place + window <= counts[row]
    return prints[whole], ids[row[whole]], place[whole], smallest[whole]


def block_runs(batches: Iterator[pa.RecordBatch], window: int, gram: int, blocks: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, runs of letters) and (-1 - share, spans known already).

    Letters that recur within a slice of documents are decided here: only the first one travels, so that
    a passage of very many documents reaches its block once per slice.
    """
    for batch in batches:
        batch = common.in_order(batch)
        ids, texts = np.asarray(batch.column(0)).astype(np.int64), batch.column(1).to_pylist()
        for a, b in common.byte_slices(texts, SLICE_BYTES):
            prints, docs, places, smallest = letters(ids[a:b], texts[a:b], window, gram)
            if not len(prints):
                continue
            repeated = earlier(prints, docs, places) >= 0
            follows = np.r_[False, (docs[1:] == docs[:-1]) & (places[1:] == places[:-1] + 1)]
            chain = np.cumsum(~follows)
            start, end = runs(prints, chain, repeated)
            rows = [(-1 - k, note) for k, note in common.span_rows(docs[start], places[start], places[end - 1] + window, shares)]
            owner = np.cumsum(~follows | np.r_[True, smallest[1:] != smallest[:-1]])
            start, end = runs(prints, owner, ~repeated)
            lengths = end - start
            block = (common.mixed(smallest[start]) % np.uint64(blocks)).astype(np.int32)
            for key, (s, n) in common.split_by(block, start, lengths):
                at = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                rows.append((key, common.pack(docs[s], places[s].astype(np.int32), n.astype(np.int32), prints[at])))
            yield common.key_batch(rows)


def parsed_blocks(batches: Iterator[pa.RecordBatch], window: int, shares: int) -> Iterator[pa.RecordBatch]:
    """Rows (share, spans): every block parsed against itself, what was known before passed on."""
    for key, blobs in common.groups(batches):
        if key < 0:
            yield common.key_batch([(-1 - key, blob) for blob in blobs])
            continue
        docs, places, lengths, prints = common.joined(blobs)
        begins = np.r_[0, np.cumsum(lengths.astype(np.int64))[:-1]]
        order = np.lexsort((places, docs))
        n = lengths[order].astype(np.int64)
        inner = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        prints = prints[np.repeat(begins[order], n) + inner]
        ids, at = np.repeat(docs[order], n), np.repeat(places[order].astype(np.int64), n) + inner
        linked = np.r_[False, (ids[1:] == ids[:-1]) & (at[1:] == at[:-1] + 1)] if len(ids) else np.zeros(0, bool)
        start, end, _ = factors(prints, numbered(ids, at), linked)
        if len(start):
            yield common.key_batch(common.span_rows(ids[start], at[start], at[end - 1] + window, shares))


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for spans, ids, texts in common.noted_spans(batches):
        out = []
        for doc_id, text in zip(ids, texts, strict=True):
            words = (text or b"").split()
            cut = spans.of(doc_id)
            kept, at = [], 0
            for start, end in cut:
                kept += words[at:start]
                at = end
            kept += words[at:]
            line = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(), line, [s for s, _ in cut], [e for _, e in cut]))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
            pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int64())),
        ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "starts", "ends"])


def repeated_passages(documents: DataFrame, window: int = 20, gram: int = GRAM) -> DataFrame:
    """One row per document: n_words, n_removed, kept (the words left, joined by one space), its kept_sha256,
    and the removed spans as word positions (starts, ends).

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Null texts have no words. Rows without a doc_id have no place in the order: they
    match nothing and stay whole. Rows that repeat a doc_id share its places, so equal windows of theirs are no
    earlier ones. Other columns are ignored. An empty table gives an empty result.
    """
    if not 0 < gram <= window <= 32_000:
        raise ValueError("gram must be between 1 and window")
    spark = documents.sparkSession
    common.on_workers(spark)
    n = common.partitions(spark)
    shares = blocks = 4 * n
    texts = common.texts_of(documents)
    dealt = texts.dropna().mapInArrow(lambda b: block_runs(b, window, gram, blocks, shares), "key int, note binary")
    spans = common.by_key(dealt, n).mapInArrow(lambda b: parsed_blocks(b, window, shares), "key int, note binary")
    return common.with_notes(texts, spans, shares, n).mapInArrow(
        cut_words, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, starts array<long>, ends array<long>")
