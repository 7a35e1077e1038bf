"""Language-model scores by online logistic context mixing.

A token is a path in a code tree over the most frequent training words and buckets of all others: every step is one bit,
told by several predictors: by the tree node alone, and by what training texts had at that node after the same word, the
same two and the same three words. The predictions are mixed in the logistic domain with weights chosen by a gate (how
much the contexts have seen, how deep the node is), which are learned online, bit after bit, on one fold of the training
texts with the counts of the others; a last table refines the mixed probability by what came of it there. Scores then
take the counts of all training texts. Words outside the tree have a path to their bucket, so contexts tell these too,
and are told within it by their training counts. The sum of all bits is the text's total.

Nothing a context has seen is merged with another context or dropped: every token goes by a shuffle to the block of the
word before it, with the two words before that (those outside the tree as 31 bits of their codes). There the training
tokens of a context stand sorted by their place in the tree, so that the zeros and ones of a node are the lengths of two
ranges. A block tells its tokens' bits and sends sums to the documents. Texts are cut into tokens once for all of this
and never go through an exchange themselves. Blocks follow the session's partitions. After words that make up over one
in ``SPREAD`` of all tokens, tokens are dealt by the two words before, and the counts after the one word, at most as many
as such words times leaves, are broadcast. A block learns its own weights; they are frozen before it scores.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common
from formgrain.llm.common import stored

END = xxhash.xxh64_intdigest(b"")
COUNTED = 400_000
SLICE_BYTES = 1 << 19
PARTS = 64
ORDERS = 3
SPREAD = 1024
CHUNK = 1 << 14
REFINED = 24


@dataclass(frozen=True)
class Settings:
    """``tree``: words with a path of their own; ``common``: words whose counts every worker has; ``buckets``: most
    buckets for the words without one, about ``in_bucket`` in each; ``slot_bits`` is kept for callers and changes nothing;
    ``batch``: bits between two steps of the weights; ``folds``, ``test``: which rows teach nothing; ``mixed``: fold whose
    rows teach the weights from the counts of the others."""

    tree: int = 1 << 18
    common: int = 1 << 18
    buckets: int = 1 << 14
    in_bucket: int = 16
    slot_bits: int = 19
    rate: float = 0.02
    batch: int = 2048
    folds: int = 5
    test: int = 1
    mixed: int = 4


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' tokens, each text's end included, and tokens per text."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) + 1 for w in words], np.int64)
    codes = np.full(int(counts.sum()), END, np.uint64)
    is_word = np.ones(len(codes), bool)
    is_word[np.cumsum(counts) - 1] = False
    codes[is_word] = common.CODES.of([x for w in words for x in w])
    return codes, counts


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n) of a task's tokens, summed as far as memory is meant to hold them."""
    def rows(counts):
        codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(list(counts.values()), pa.int64())], names=["code", "n"])

    counts: Counter[bytes] = Counter()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for text in texts:
            counts.update((text or b"").lower().split())
            if len(counts) > COUNTED:
                yield rows(counts)
                counts = Counter()
        counts[b""] += len(texts)
    yield rows(counts)


def huffman_lengths(weights: np.ndarray) -> np.ndarray:
    """Code lengths of the leaves: the two lightest nodes are joined until one is left, leaves before joined ones."""
    n = len(weights)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(weights, kind="stable")
    leaves, joined, parent = weights[order].tolist(), [], np.zeros(2 * n - 1, np.int64)
    i = j = 0
    for new in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            if j >= len(joined) or i < n and leaves[i] <= joined[j]:
                total, parent[i], i = total + leaves[i], new, i + 1
            else:
                total, parent[n + j], j = total + joined[j], new, j + 1
        joined.append(total)
    depth = [0] * (2 * n - 1)
    for k, above in zip(range(2 * n - 3, -1, -1), parent[2 * n - 3::-1].tolist(), strict=True):
        depth[k] = depth[above] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of words that have no leaf of their own."""
    return (common.mixed(codes ^ np.uint64(common.MULTIPLIER)) % np.uint64(buckets)).astype(np.int64)


class Tree:
    """A canonical Huffman code of the most frequent words and of the buckets of all others, and the counts of the common
    words. Only words, counts and code lengths travel; a worker builds the rest once."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, total: int, distinct: int, s: Settings, rare: np.ndarray | None = None):
        """Codes and counts by falling count; ``total`` and ``distinct``: of all training tokens. ``rare``: for each
        bucket the sum of count + 0.5 over the training words that are not among ``codes``; without it there is one."""
        k = min(s.tree, len(codes))
        rare = np.array([float(total - counts.sum()) + 0.5 * (distinct - len(codes))]) if rare is None else rare
        own = np.bincount(bucket_of(codes[k:], len(rare)), counts[k:] + 0.5, len(rare))
        self.total, self.distinct, self.k = total, distinct, k
        #: What the probabilities within a bucket are taken of, half a count for words never seen included.
        self.outside = rare + own + 0.5
        self.words, self.counted = codes, counts
        self.lengths = huffman_lengths(np.append(counts[:k].astype(np.float64), self.outside))
        self.build()

    def __reduce__(self):
        return rebuilt, (self.total, self.distinct, self.k, self.outside, self.words, self.counted, self.lengths.astype(np.int8))

    def build(self) -> None:
        weights = np.append(self.counted[:self.k].astype(np.float64), self.outside)
        self.leaves, most = len(weights), int(self.lengths.max(initial=0))
        # Shorter codes come first, so the leaves from left to right are sorted by length.
        order = np.argsort(self.lengths, kind="stable")
        self.place = np.empty(self.leaves, np.int64)
        self.place[order] = np.arange(self.leaves)
        at_depth = np.bincount(self.lengths, minlength=most + 1)
        first = np.zeros(most + 1, np.uint64)
        for d in range(1, most + 1):
            first[d] = (first[d - 1] + np.uint64(at_depth[d - 1])) << np.uint64(1)
        rank = np.arange(self.leaves) - np.r_[0, np.cumsum(at_depth)][self.lengths[order]]
        self.code = np.empty(self.leaves, np.uint64)
        self.code[order] = first[self.lengths[order]] + rank.astype(np.uint64)
        # Inner nodes of a depth stand to the right of its leaves, and are numbered from the root down.
        inner = np.zeros(most + 1, np.int64)
        nodes = 1
        for d in range(most + 1):
            inner[d] = nodes - at_depth[d]
            nodes = 2 * inner[d]
        self.leftmost = first + at_depth.astype(np.uint64)
        self.base = np.cumsum(inner) - inner
        depth = np.repeat(np.arange(most + 1), inner)
        prefix = self.leftmost[depth] + (np.arange(len(depth)) - self.base[depth]).astype(np.uint64)
        shift = (most - depth).astype(np.uint64)
        ends = (self.code << (most - self.lengths).astype(np.uint64))[order]
        half = np.uint64(1) << np.maximum(shift, np.uint64(1)) - np.uint64(1)
        self.ends, self.aligned, self.most = ends, self.code << (most - self.lengths).astype(np.uint64), most
        start, self.middle = np.searchsorted(ends, prefix << shift), np.searchsorted(ends, (prefix << shift) + half)
        stop = np.searchsorted(ends, (prefix << shift) + half + half - np.uint64(1), "right")
        below = np.r_[0.0, np.cumsum(weights[order])]
        ones, all_ = below[stop] - below[self.middle], below[stop] - below[start]
        self.logit = stretch((ones + 0.1) / (all_ + 0.2)).astype(np.float32)
        self.level = np.minimum(depth // 4, 3).astype(np.int8)
        self.hot = np.sort(self.words[self.counted * SPREAD > self.total])
        order = np.argsort(self.words)
        self.codes, self.counts = self.words[order], self.counted[order].astype(np.float64)
        self.rank = np.where(order < self.k, order, self.k + bucket_of(self.codes, len(self.outside))).astype(np.int32)
        # Codes are evenly spread, so their leading bits nearly say where they stand.
        self.shift = np.uint64(64 - max(1, len(self.codes)).bit_length())
        self.first = np.searchsorted(self.codes >> self.shift, np.arange(2 << int(np.uint64(63) - self.shift), dtype=np.uint64))

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf (from k on: a bucket) and count (-1: not among the common words) of every token."""
        leaf, count = np.full(len(codes), -1, np.int32), np.full(len(codes), -1.0)
        left, at = np.arange(len(codes)), self.first[codes >> self.shift]
        while len(left):
            inside = at < len(self.codes)
            left, at = left[inside], at[inside]
            here, wanted = self.codes[at], codes[left]
            hit = here == wanted
            leaf[left[hit]], count[left[hit]] = self.rank[at[hit]], self.counts[at[hit]]
            more = here < wanted
            left, at = left[more], at[more] + 1
        far = leaf < 0
        leaf[far] = self.k + bucket_of(codes[far], len(self.outside))
        return leaf, count


def rebuilt(total, distinct, k, outside, words, counted_, lengths) -> Tree:
    tree = Tree.__new__(Tree)
    tree.total, tree.distinct, tree.k, tree.outside = total, distinct, k, outside
    tree.words, tree.counted, tree.lengths = words, counted_, lengths.astype(np.int64)
    tree.build()
    return tree


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def path(tree: Tree, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bits of the tokens, from the root down: token, node, bit."""
    n = tree.lengths[leaf]
    token = np.repeat(np.arange(len(leaf)), n)
    depth = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    left = (n[token] - depth).astype(np.uint64)
    code = tree.code[leaf][token]
    node = tree.base[depth] + ((code >> left) - tree.leftmost[depth]).astype(np.int64)
    return token, node, (code >> (left - np.uint64(1)) & np.uint64(1)).astype(np.int8)


def contexts(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each token, prints of the two and of the three before; before a text stand ends."""
    before = words_before(codes, counts, END)
    two = common.mixed(before[0] + np.uint64(7)) + before[1]
    return before[0], two, common.mixed(two) + before[2]


def hot_index(tree: Tree, codes: np.ndarray) -> np.ndarray:
    """Which of the hot words; -1: none."""
    if not len(tree.hot):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(tree.hot, codes), len(tree.hot) - 1)
    return np.where(tree.hot[at] == codes, at, -1)


def hot_followers(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    """Rows (hot word, places in the tree of the words after it and how often)."""
    size = tree.value.leaves
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).to_pylist()]
        for a, b in common.byte_slices(texts, SLICE_BYTES * 16):
            codes, counts = tokens(texts[a:b])
            hot = hot_index(tree.value, contexts(codes, counts)[0])
            keys, n = np.unique(hot[hot >= 0] * size + tree.value.place[tree.value.look_up(codes[hot >= 0])[0]], return_counts=True)
            yield common.key_batch([(k, common.pack(p.astype(np.int32), m.astype(np.int64))) for k, (p, m) in common.split_by(keys // size, keys % size, n)])


def followers_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, blobs in common.groups(batches):
        places, n = common.joined(blobs)
        places, which = np.unique(places, return_inverse=True)
        yield common.key_batch([(key, common.pack(places, np.bincount(which, n).astype(np.int64)))])


class Seen:
    """Sorted keys (context, place in the tree), and how many training tokens stand before each."""

    def __init__(self, keys: np.ndarray, before: np.ndarray):
        self.keys, self.before = keys, before

    @classmethod
    def of(cls, keys: np.ndarray) -> Seen:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return cls(keys[first], np.r_[first, len(keys)].astype(np.int32 if len(keys) < 1 << 31 else np.int64))

    def counts(self, tree: Tree, context: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones at every node of the tokens' paths, in the order of ``path``. A negative context has seen nothing."""
        n = tree.lengths[leaf]
        size = int(n.sum())
        asked = np.flatnonzero((context >= 0) & (n > 0))
        if not len(asked) or not len(self.keys):
            return np.zeros(size, np.int64), np.zeros(size, np.int64)
        # Tokens with one context and leaf have the same counts, and neighbours look into the same few keys.
        pair, which = np.unique(context[asked] * tree.leaves + leaf[asked], return_inverse=True)
        contexts_, leaves = np.divmod(pair, tree.leaves)
        low, high = np.searchsorted(self.keys, [contexts_[0] * tree.leaves, (contexts_[-1] + 1) * tree.leaves])
        zeros, ones = self.between(tree, contexts_, leaves, int(low), int(high))
        length = n[asked]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        first = np.cumsum(tree.lengths[leaves]) - tree.lengths[leaves]
        at = np.repeat(first[which], length) + inside
        if len(asked) == len(n):
            return zeros[at], ones[at]
        out = np.repeat((np.cumsum(n) - n)[asked], length) + inside
        all_zeros, all_ones = np.zeros(size, np.int64), np.zeros(size, np.int64)
        all_zeros[out], all_ones[out] = zeros[at], ones[at]
        return all_zeros, all_ones

    def between(self, tree: Tree, context: np.ndarray, leaf: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for sorted pairs of context and leaf, whose keys stand between two places."""
        keys, before = self.keys[low:high], self.before[low:high + 1]
        n = tree.lengths[leaf]
        first = np.cumsum(n) - n
        zeros, ones = np.zeros(int(n.sum()), np.int64), np.zeros(int(n.sum()), np.int64)
        base = context * tree.leaves
        left, right = np.searchsorted(keys, base), np.searchsorted(keys, base + tree.leaves)
        live, depth, alone = np.flatnonzero(left < right), 0, []
        left, right, base = left[live], right[live], base[live]
        code, length, out = tree.code[leaf[live]], n[live], first[live]
        while len(live):
            single = right - left == 1
            if single.any():
                some = np.flatnonzero(single)
                at = left[some]
                alone.append((keys[at] - base[some], before[at + 1] - before[at], leaf[live[some]], out[some], np.full(len(some), depth)))
                some = np.flatnonzero(~single)
                live, left, right, base, code, length, out = (x[some] for x in (live, left, right, base, code, length, out))
            below = (length - depth).astype(np.uint64)
            node = tree.base[depth] + ((code >> below) - tree.leftmost[depth]).astype(np.int64)
            middle = np.searchsorted(keys, base + tree.middle[node])
            zeros[out + depth], ones[out + depth] = before[middle] - before[left], before[right] - before[middle]
            one = (code >> (below - np.uint64(1)) & np.uint64(1)).astype(bool)
            left, right = np.where(one, middle, left), np.where(one, right, middle)
            depth += 1
            on = np.flatnonzero((left < right) & (length > depth))
            live, left, right, base, code, length, out = (x[on] for x in (live, left, right, base, code, length, out))
        if alone:
            self.only(tree, *(np.concatenate(x) for x in zip(*alone, strict=True)), zeros, ones)
        return zeros, ones

    @staticmethod
    def only(tree: Tree, place, times, leaf, out, depth, zeros: np.ndarray, ones: np.ndarray) -> None:
        """What is left of paths below a node where training tokens went to one leaf only: they go along with the path as far
        as the two codes agree, and where they part for the first time stand on the other side."""
        length = tree.lengths[leaf]
        apart = tree.ends[place] ^ tree.aligned[leaf]
        agree = np.where(apart > 0, tree.most - np.frexp(apart.astype(np.float64))[1], length)
        n = np.minimum(agree + 1, length) - depth
        token = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(token)) - (np.cumsum(n) - n)[token]
        bit = (tree.code[leaf] << (64 + depth - length).astype(np.uint64))[token] << step.astype(np.uint64)
        one = (bit >> np.uint64(63) == 1) != (step == (agree - depth)[token])
        where, seen = (out + depth)[token] + step, times[token]
        ones[where] = seen * one
        zeros[where] = seen - ones[where]


def pressed(*arrays: np.ndarray) -> bytes:
    """``common.pack`` with the first bytes of all values together, then the second ones and so on, compressed."""
    planes = (np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).reshape(-1).view(a.dtype) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(common.pack(*planes))


def unpressed(blob: bytes) -> list[np.ndarray]:
    arrays = common.unpack(zstandard.ZstdDecompressor().decompress(blob))
    return [np.ascontiguousarray(a.view(np.uint8).reshape(a.itemsize, len(a)).T).reshape(-1).view(a.dtype) for a in arrays]


def short(tree: Tree, codes: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """A word in 32 bits: its leaf, or for words outside the tree 31 bits of its code, the first bit set."""
    return np.where(leaf < tree.k, leaf.astype(np.uint32), (codes >> np.uint64(9)).astype(np.uint32) | np.uint32(1 << 31))


def words_before(words: np.ndarray, counts: np.ndarray, end) -> list[np.ndarray]:
    """The first, second and third word before each token; before a text stand ends."""
    inside = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    return [np.where(inside >= k, np.r_[np.zeros(k, words.dtype), words][:len(words)], words.dtype.type(end)) for k in (1, 2, 3)]


TOKENS, FAR, KNOWN, DOCUMENTS, SUMS = b"T", b"F", b"K", b"D", b"S"
#: Sums of so many documents are held by a task before they are sent on.
HELD = 4_000_000


def framed(notes: list[tuple[bytes, bytes]]) -> bytes:
    """Notes (kind, content) in one value."""
    return b"".join(kind + len(content).to_bytes(8, "little") + content for kind, content in notes)


def unframed(blobs: list[bytes]) -> dict[bytes, list[bytes]]:
    notes: dict[bytes, list[bytes]] = {kind: [] for kind in (TOKENS, FAR, KNOWN, DOCUMENTS, SUMS)}
    for blob in blobs:
        at = 0
        while at < len(blob):
            end = at + 9 + int.from_bytes(blob[at + 1:at + 9], "little")
            notes[blob[at:at + 1]].append(blob[at + 9:end])
            at = end
    return notes


def cut_texts(batches: Iterator[pa.RecordBatch], tree, blocks: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """All that is made of texts, in one pass, as one row per block and slice of documents: tokens with their contexts and
    documents, sorted by the word before; words outside the common ones, with how often they stand in which document;
    and, once, the documents with what the common words alone say.

    A document is told by its slice, named by its rows, and its number there; those that teach come before those that
    are held out.
    """
    t: Tree = tree.value
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        folds = np.asarray(batch.column(2))
        kinds = np.where(folds == s.test, 2, np.where(folds == s.mixed, 1, 0)).astype(np.int8)
        for a, b in common.byte_slices(texts, SLICE_BYTES * 4):
            order = np.argsort(kinds[a:b], kind="stable")
            part, doc_ids = [texts[a + k] for k in order.tolist()], batch.column(0).slice(a, b - a).take(pa.array(order))
            name = np.array([xxhash.xxh3_64_intdigest(common.row_ids(doc_ids.to_pylist(), part).tobytes())], np.uint64).view(np.int64)
            upto = np.searchsorted(kinds[a:b][order], [1, 2]).astype(np.int32)
            codes, counts = tokens(part)
            leaf, known = t.look_up(codes)
            row = np.repeat(np.arange(len(part), dtype=np.int32), counts)
            notes: dict[int, list[tuple[bytes, bytes]]] = defaultdict(list)
            for block, columns in dealt_tokens(t, codes, counts, leaf, row, blocks):
                notes[block].append((TOKENS, pressed(*columns, name, upto)))
            for block, columns in far_words(codes[known < 0], row[known < 0], blocks):
                notes[block].append((FAR, pressed(*columns, name)))
            logs, escaped = np.log10(np.maximum(known, 0) + 0.5), leaf >= t.k
            within = logs[escaped] - np.log10(t.outside[leaf[escaped] - t.k])
            per = lambda rows, weights=None, n=len(part): np.bincount(rows, weights, n)
            notes[int(name[0] % blocks)].append((DOCUMENTS, pressed(
                np.asarray(doc_ids.fill_null(0)).astype(np.int64), np.asarray(doc_ids.is_null()).astype(np.int8), counts.astype(np.int32),
                per(row[known > 0]).astype(np.int32), per(row, logs), per(row[escaped], within), np.array([len(x) for x in part], np.int64), name)))
            yield common.key_batch([(block, framed(found)) for block, found in notes.items()])


def dealt_tokens(tree: Tree, codes, counts, leaf, row, blocks: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    one, two, _ = contexts(codes, counts)
    hot = hot_index(tree, one).astype(np.int16)
    block = blocks_of(np.where(hot >= 0, two, one), blocks)
    words = short(tree, codes, leaf)
    before = words_before(words, counts, short(tree, np.array([END], np.uint64), tree.look_up(np.array([END], np.uint64))[0])[0])
    order = np.lexsort((before[0].astype(np.uint64) << np.uint64(32) | before[1], block))
    cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True])
    columns = [x[order] for x in (*before, leaf, hot, row)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(block[order[i]]), [x[i:j] for x in columns]


def far_words(codes, row, blocks: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Words, documents and how often a word stands in one."""
    order = np.lexsort((row, codes))
    row, codes = row[order], codes[order]
    new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])]) if len(codes) else np.zeros(0, int)
    times = np.diff(np.r_[new, len(codes)]).astype(np.int32)
    yield from common.split_by(blocks_of(codes[new], blocks), codes[new], row[new], times)


def block_tokens(notes: list[bytes], tree: Tree) -> list[np.ndarray]:
    """The first, second and third word before, leaf, hot word before, document and kind of a block's tokens, in an
    order that follows from themselves, and the names of the slices. A document is slice number << 32 | its number there."""
    parts = sorted(map(unpressed, notes), key=lambda x: int(x[6][0]))
    one, two, three, leaf, hot = (np.concatenate([x[k] for x in parts]) for k in range(5))
    owner = np.concatenate([x[5].astype(np.int64) | k << 32 for k, x in enumerate(parts)])
    kind = np.concatenate([np.searchsorted(x[7], x[5], "right") for x in parts]).astype(np.int8)
    nearest, rest = (a.astype(np.uint64) << np.uint64(32) | b for a, b in ((one, two), (three, tree.place[leaf].astype(np.uint64))))
    order = np.lexsort((owner, rest, nearest))
    return [c[order] for c in (one, two, three, leaf, hot, owner, kind)] + [np.array([x[6][0] for x in parts], np.int64)]


class Block:
    """Tokens of a block with what training texts have after their contexts."""

    def __init__(self, tree: Tree, followers: Seen, one, two, three, leaf, known, owner, kind):
        self.tree, self.leaf, self.owner, self.kind, self.three = tree, leaf, owner, kind, three
        changes = np.stack([np.r_[False, x[1:] != x[:-1]] for x in (one, two, three)])
        self.group = np.cumsum(np.logical_or.accumulate(changes), axis=1, dtype=np.int32)
        self.followers, self.known = followers, known.astype(np.int64)

    def counted(self, taught: np.ndarray) -> list[Seen]:
        """What these tokens have after the contexts of each order."""
        teaches = [taught & (self.known < 0), *[taught] * (ORDERS - 1)]
        return [Seen.of(group[some].astype(np.int64) * self.tree.leaves + self.tree.place[self.leaf[some]]) for group, some in zip(self.group, teaches, strict=True)]

    @cached_property
    def seen(self) -> list[Seen]:
        """Of all training texts."""
        return self.counted(self.kind < 2)

    def predicted(self, some: np.ndarray, counts: list[Seen], leaf: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Token, bit, inputs and gate of all bits of these tokens (or of other leaves in their contexts)."""
        leaf = self.leaf[some] if leaf is None else leaf
        token, node, bit = path(self.tree, leaf)
        hot = self.known[some]
        found = []
        for k in range(ORDERS):
            context = self.group[k][some].astype(np.int64)
            zeros, ones = counts[k].counts(self.tree, np.where(hot < 0, context, -1) if k == 0 else context, leaf)
            if k == 0 and (hot >= 0).any():
                # After a hot word the counts come from the broadcast table.
                more = self.followers.counts(self.tree, hot, leaf)
                zeros, ones = zeros + more[0], ones + more[1]
            found.append(logits(zeros, ones))
        x, gate = gated(self.tree, node, found)
        return token, bit, x, gate

    def mixer(self, s: Settings) -> Mixer:
        # The counts without the fold that teaches are held only as long as it does.
        others = self.counted(self.kind == 0)
        return learned(lambda some: self.predicted(some, others), taught_by(self.kind, self.three), s)

    def log10(self, mixer: Mixer, some: np.ndarray, leaf: np.ndarray | None = None) -> np.ndarray:
        token, bit, x, gate = self.predicted(some, self.seen, leaf)
        p = mixer.probability(x, gate)
        return np.bincount(token, np.log10(np.where(bit, p, 1 - p)), len(some))


class Sums:
    """Sums per document of the blocks of a task: tokens, known far words, what these add, log10 probabilities."""

    def __init__(self, shares: int):
        self.shares, self.held, self.size = shares, [], 0

    def add(self, names: np.ndarray, numbers: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((names, numbers.astype(np.int64), *columns))
        self.size += len(names)
        if self.size > HELD:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        names, numbers, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((numbers, names))
        names, numbers = names[order], numbers[order]
        new = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])])
        n, known, far, told_ = (np.add.reduceat(c[order], new) for c in columns)
        names, numbers = names[new], numbers[new].astype(np.int32)
        rows = []
        for share, part in common.split_by(common.targets(names, self.shares), names, numbers, n.astype(np.int32), known.astype(np.int32), far, told_):
            first = np.flatnonzero(np.r_[True, part[0][1:] != part[0][:-1]])
            # A slice is named once, with how many of its documents follow.
            rows.append((share, framed([(SUMS, pressed(part[0][first], np.diff(np.r_[first, len(part[0])]), *part[1:]))])))
        yield common.key_batch(rows)
        self.held, self.size = [], 0


def told(batches: Iterator[pa.RecordBatch], tree, hot, shares: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (share, notes): the documents as they came, and for those with tokens or far words in the task's blocks the
    number of tokens, sums of their bits' log10 probabilities, and what the far words' counts add."""
    t, followers, sums = tree.value, hot.value, Sums(shares)
    for _, blobs in common.groups(batches):
        notes = unframed(blobs)
        for note in notes[DOCUMENTS]:
            yield common.key_batch([(int(common.targets(unpressed(note)[-1], shares)[0]), framed([(DOCUMENTS, note)]))])
        if notes[TOKENS]:
            *columns, names = block_tokens(notes[TOKENS], t)
            block = Block(t, followers, *columns)
            mixer, logs = block.mixer(s), np.zeros(len(block.leaf))
            for at in range(0, len(logs), CHUNK):
                some = np.arange(at, min(at + CHUNK, len(logs)))
                logs[some] = block.log10(mixer, some)
            owner, which = np.unique(block.owner, return_inverse=True)
            none = np.zeros(len(owner))
            yield from sums.add(names[owner >> 32], owner & 0xFFFFFFFF, np.bincount(which), none, none, np.bincount(which, logs))
        if notes[FAR] and notes[KNOWN]:
            yield from far_sums(notes[FAR], notes[KNOWN], sums)
    yield from sums.sent()


def taught_by(kind: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Tokens that teach the weights: neighbours together, as they look into the same counts, in parts of ``CHUNK`` whose
    order has nothing to do with their contexts."""
    some = np.flatnonzero(kind == 1)
    parts = [some[at:at + CHUNK] for at in range(0, len(some), CHUNK)]
    drawn = [int(common.mixed(np.array([np.add.reduce(common.mixed(words[p].astype(np.uint64)))]))[0]) for p in parts]
    return [parts[k] for k in np.argsort(np.array(drawn, np.uint64), kind="stable").tolist()]


#: Logarithms of the counts that most nodes have.
LOGS = np.log(np.arange(1 << 12) + 0.2).astype(np.float32)


def logs_of(counts: np.ndarray) -> np.ndarray:
    out = LOGS[np.minimum(counts, len(LOGS) - 1)]
    large = np.flatnonzero(counts >= len(LOGS))
    out[large] = np.log(counts[large] + 0.2)
    return out


def logits(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of (ones + 0.2) / (seen + 0.4) and confidences: 0 for nothing seen, up to 3."""
    seen = zeros + ones
    sure = (seen >= 1).astype(np.int8) + (seen >= 4) + (seen >= 32)
    return logs_of(ones) - logs_of(zeros), sure.astype(np.int8)


def gated(tree: Tree, node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Logits of each predictor for every bit, and the bits' gates, from logits and confidences of the contexts."""
    x = [tree.logit[node]]
    gate = tree.level[node].astype(np.int32)
    for logit, sure in found:
        # A context that has seen nothing says what the node says.
        x.append(np.where(sure > 0, logit, x[0]))
        gate = gate * np.int32(4) + sure
    return x, gate


GATES = 4 ** (ORDERS + 1)


class Mixer:
    def __init__(self, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.tile(np.array([0.4] + [0.2] * ORDERS, np.float32), (GATES, 1)) if weights is None else weights
        self.refined = refined

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return sum(self.weights[:, k][gate] * x[k] for k in range(ORDERS + 1))

    @staticmethod
    def bucket(logit: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Slot of the refining table: the mixed logit in steps, for each level of the tree."""
        step = np.clip(logit * np.float32(1.5) + np.float32(REFINED // 2), 0, REFINED - 1).astype(np.int32)
        return (gate >> (2 * ORDERS)) * REFINED + step

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, s: Settings) -> np.ndarray:
        """Online steps against the error of every bit, a few bits at a time; returns the logits as they were predicted."""
        out = np.empty(len(gate), np.float32)
        for at in range(0, len(gate), s.batch):
            part = slice(at, at + s.batch)
            some, gates = [c[part] for c in x], gate[part]
            out[part] = self.mixed(some, gates)
            error = bit[part] - squash(out[part])
            n = np.sqrt(np.maximum(np.bincount(gates, minlength=GATES), 1))
            for k in range(ORDERS + 1):
                self.weights[:, k] += s.rate * np.bincount(gates, error * some[k], GATES) / n
        return out

    def probability(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Of a one."""
        logit = self.mixed(x, gate)
        p = squash(logit)
        if self.refined is not None:
            p = (p + self.refined[self.bucket(logit, gate)]) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)


def learned(predicted, parts: list[np.ndarray], s: Settings) -> Mixer:
    """Weights from these parts, more than once where they are few, and the refining table from the last time."""
    mixer = Mixer()
    size = sum(map(len, parts))
    again = int(np.clip((1 << 17) // max(1, size), 1, 4))
    for _ in range(again if size else 0):
        refine = np.zeros((2, 4 * REFINED))
        for part in parts:
            _, bit, x, gate = predicted(part)
            slot = Mixer.bucket(mixer.learn(x, gate, bit, s), gate)
            refine += np.stack([np.bincount(slot, minlength=4 * REFINED), np.bincount(slot, bit, 4 * REFINED)])
    if size:
        middle = squash((np.tile(np.arange(REFINED) - REFINED // 2 + 0.5, 4)) / 1.5)
        mixer.refined = ((refine[1] + 32 * middle) / (refine[0] + 32)).astype(np.float32)
    return mixer


def blocks_of(codes: np.ndarray, blocks: int) -> np.ndarray:
    return (common.mixed(codes) % np.uint64(blocks)).astype(np.int32)


def far_counts(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, n = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
        yield common.key_batch([(k, framed([(KNOWN, pressed(c, m))])) for k, (c, m) in common.split_by(blocks_of(codes, blocks), codes, n)])


def far_sums(far: list[bytes], known: list[bytes], sums: Sums) -> Iterator[pa.RecordBatch]:
    """Per document the known ones of its far words, and what their counts add to the sum of log10(c + 0.5) over that of c = 0."""
    codes, counts = (np.concatenate(x) for x in zip(*map(unpressed, known), strict=True))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    for words, document, times, name in map(unpressed, far):
        at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
        found = codes[at] == words
        n = times[found].astype(np.float64)
        which, tokens_of = np.unique(document[found], return_inverse=True)
        none = np.zeros(len(which))
        added = np.bincount(tokens_of, n * (np.log10(counts[at[found]] + 0.5) - np.log10(0.5)), len(which))
        yield from sums.add(np.repeat(name, len(which)), which, none, np.bincount(tokens_of, n, len(which)), added, none)


def scored(batches: Iterator[pa.RecordBatch], total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Documents of a share with the sums of all blocks."""
    base = np.log10(total + 0.5 * (distinct + 1))
    for _, blobs in common.groups(batches):
        notes = unframed(blobs)
        documents: dict[int, list[bytes]] = defaultdict(list)
        for note in notes[DOCUMENTS]:
            documents[int(unpressed(note)[-1][0])].append(note)
        parts: dict[int, list] = defaultdict(list)
        for names, lengths, *columns in map(unpressed, notes[SUMS]):
            ends = np.cumsum(lengths)
            for name, a, b in zip(names.tolist(), ends - lengths, ends, strict=True):
                parts[name].append([c[a:b] for c in columns])
        for name, same in documents.items():
            number, *columns = (np.concatenate(x) for x in zip(*parts[name], strict=True))
            doc_ids, nameless, n, n_known, logs, within, size, _ = unpressed(same[0])
            n_told, n_far, far, told_ = (np.bincount(number, c, len(n)) for c in columns)
            # Slices with the same rows have one sum.
            if (n_told != n * len(same)).any():
                raise RuntimeError("a slice of documents changed between two attempts: write the documents to a table first")
            score = told_ / len(same) + within + far / len(same)
            for _ in same:
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, mask=nameless.astype(bool)), pa.array(n.astype(np.int64)), pa.array((n_known + np.rint(n_far / len(same))).astype(np.int64)),
                    pa.array(logs + far / len(same) - n * base), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(size, 1)),
                ], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])


def fold_of(folds: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def common_words(counts: DataFrame, s: Settings) -> DataFrame:
    """The most frequent words, at most ``common``: those above a count that a histogram on a log scale finds."""
    size = F.floor(F.log2("n") * 32).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):
        taken += r.words
        if taken > s.common:
            break
        least = r["size"]
    return counts.where(size >= (1 << 30 if least is None else least))


def buckets_of(counts: DataFrame, taken: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket the sum of count + 0.5 over the words of ``counts`` that are not among ``taken``."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets)
        for batch in batches:
            sums += np.bincount(bucket_of(np.asarray(batch.column(0)).view(np.uint64), buckets), np.asarray(batch.column(1)) + 0.5, buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    rest = counts.join(taken.select("code"), "code", "left_anti").select("code", "n").mapInArrow(summed, "bucket int, n double")
    out = np.zeros(buckets)
    for r in rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def train(documents: DataFrame, s: Settings) -> tuple[Tree, Seen, DataFrame]:
    """The code tree, what stands after hot words, and the counts (code, n) of all training tokens."""
    spark = documents.sparkSession
    n = common.partitions(spark)
    taught = folded(documents, s).where(F.col("fold") != s.test)
    counts = stored(taught.select("text").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "token-counts")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    taken = common_words(counts, s)
    top = taken.toPandas().sort_values(["n", "code"], ascending=[False, True])
    buckets = int(np.clip((distinct - min(s.tree, len(top))) // s.in_bucket, 1, s.buckets))
    codes, found = top["code"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    tree = Tree(codes, found, total, distinct, s, buckets_of(counts, taken, buckets))
    held = spark.sparkContext.broadcast(tree)
    rows = "key int, note binary"
    parts = taught.select("text").mapInArrow(lambda b: hot_followers(b, held), rows)
    found = sorted(tuple(r) for r in common.by_key(parts, min(n, max(1, len(tree.hot)))).mapInArrow(followers_joined, rows).collect())
    blobs = [(k, *common.unpack(blob)) for k, blob in found]
    keys = np.concatenate([np.zeros(0, np.int64), *(k * tree.leaves + places.astype(np.int64) for k, places, _ in blobs)])
    return tree, Seen(keys, np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *(m for _, _, m in blobs)]))]), counts


def folded(documents: DataFrame, s: Settings) -> DataFrame:
    return common.texts_of(documents).withColumn("fold", F.coalesce(fold_of(s.folds), F.lit(s.folds)))


def language_scores(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the words of the text with A-Z in lower case, and one end. ``score`` is the model's log10 probability of the
    text, ``base_score`` that of smoothed token counts, ``bits_per_byte`` the model's total bits over the UTF-8 bytes (over
    one for an empty text). Null texts are empty: their end is scored alone. Rows without a doc_id are learned from and
    not held out; repeated rows teach as often as they stand. Other columns are ignored. An empty table gives an empty
    result; without training rows every token has probability one half over one half.
    """
    s = settings
    spark = documents.sparkSession
    common.on_workers(spark)
    n = common.partitions(spark)
    # A slice writes one row per block, and a task one per share: few of both keep rows few where there are many partitions.
    shares, blocks = max(1, n // 4), 5 * n
    trained, followers, counts = train(documents, s)
    tree, hot = spark.sparkContext.broadcast(trained), spark.sparkContext.broadcast(followers)
    total, distinct, rows = trained.total, trained.distinct, "key int, note binary"
    cut = folded(documents, s).mapInArrow(lambda b: cut_texts(b, tree, blocks, s), rows)
    known = counts.mapInArrow(lambda b: far_counts(b, blocks), rows)
    sums = common.by_key(cut.unionByName(known), n).mapInArrow(lambda b: told(b, tree, hot, shares, s), rows)
    columns = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    out = common.by_key(sums, n).mapInArrow(lambda b: scored(b, total, distinct), columns)
    return out.select(
        "doc_id", F.coalesce(fold_of(s.folds) == s.test, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(trained.total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
