"""Near-duplicate documents by MinHash bands, with odd sketches before the exact check.

Documents with one and the same shingle set are one node. A node's MinHash samples give its band keys and its odd
sketch: every sample flips one bit, so the bits in which two sketches differ tell how many samples differ. A second
sketch of the same kind, over all shingles, differs in no more bits than the sets differ in shingles, which bars pairs
just below the threshold without a doubt. Nodes that share a band key are candidates. In each band every node meets the band's smallest node; what the exact check on full
sets confirms is joined to components. Then nodes of one band that are still in different components meet too, if
their sketches let them be similar; so a link can only go unfound if no band is shared or a sketch is off by five
deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common
from formgrain.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """Two sets of similarity 0.8 share none of the 40 bands of 5 samples with a chance of about 1 in 10 million.

    ``margin``: how far below ``similar`` (in percent) an estimate may lie before a pair is left out.
    """

    words: int = 4
    similar: int = 80
    bands: int = 40
    rows: int = 5
    sketch_longs: int = 8
    set_longs: int = 16
    margin: int = 25
    tile: int = 4096


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted prints of the distinct shingles; a shorter text is one shingle."""
    codes = common.CODES.of(text.lower().split())
    return np.unique(common.rolling(codes, min(width, len(codes)))) if len(codes) else np.zeros(0, np.uint64)


def node_of(prints: np.ndarray) -> int:
    """One number for one set."""
    return int(np.array(xxhash.xxh3_64_intdigest(prints.tobytes()), np.uint64).astype(np.int64))


def multipliers(n: int) -> np.ndarray:
    return common.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(common.MULTIPLIER)) | np.uint64(1)


def samples(prints: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash samples: the smallest product of any print with each factor."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(prints), 512):
        best = np.minimum(best, (prints[at:at + 512, None] * factors[None, :]).min(axis=0))
    return common.mixed(best) + np.arange(len(best), dtype=np.uint64)


def band_keys(found: np.ndarray, s: Settings) -> np.ndarray:
    powers = multipliers(s.rows + s.bands)
    return common.mixed((found.reshape(s.bands, s.rows) * powers[:s.rows]).sum(axis=1, dtype=np.uint64) + powers[s.rows:])


def odd_sketch(found: np.ndarray, longs: int) -> np.ndarray:
    bits = 64 * longs
    flips = common.mixed(found) % np.uint64(bits)
    return np.packbits(np.bincount(flips.astype(np.int64), minlength=bits) & 1).view(np.int64)


def most_different_bits(s: Settings) -> int:
    """Different bits expected at the least similarity that is still looked at."""
    bits, apart = 64 * s.sketch_longs, 2 * s.bands * s.rows * (1 - (s.similar - s.margin) / 100)
    return int(np.ceil(bits * (1 - (1 - 2 / bits) ** apart) / 2))


def described(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    factors = multipliers(s.bands * s.rows)
    for batch in batches:
        rows = []
        for doc_id, text, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            prints = shingles(text or b"", s.words)
            if not len(prints):
                rows.append((row, doc_id, 0, None, None, None, None))
                continue
            found = samples(prints, factors)
            rows.append((row, doc_id, len(prints), node_of(prints), band_keys(found, s).view(np.int64), odd_sketch(found, s.sketch_longs), odd_sketch(prints, s.set_longs)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["row", "doc_id", "n_shingles", "node", "keys", "sketch", "parity"])


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            prints = shingles(text or b"", width)
            if len(prints) and node_of(prints) == node:
                nodes.append(node)
                sets.append(prints.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "prints"])


def confirmed(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= similar * (len(a) + len(b) - both))
        keep = pa.array(good, pa.bool_())
        yield batch.select([0, 1]).filter(keep)


def rows_of(documents: DataFrame) -> DataFrame:
    """doc_id, text and the key of each row."""
    return common.texts_of(documents).withColumn("row", common.row_key())


def links(documents: DataFrame, described_documents: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = described_documents.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row")).join(wanted, "node")
    texts = rows_of(documents).join(owners, "row").select("node", "text")
    sets = stored(texts.mapInArrow(lambda b: sets_of(b, s.words), "node long, prints binary").dropDuplicates(["node"]), "shingle-sets")
    sized = pairs.join(sets.select(F.col("node").alias("a"), F.col("prints").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("prints").alias("right")), "b")
    found = stored(sized.select("a", "b", "left", "right").mapInArrow(lambda b: confirmed(b, s.similar), "a long, b long"), "links")
    common.discard(sets)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the smallest node of its component.

    Alternating star operations: all neighbours of a node are tied to the smallest one, first the larger, then the
    smaller neighbours, until nothing changes. Every round is written down, so no lineage grows, and removed once the
    next one is.
    """
    state, edges = None, stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            labels.stored_at = edges.stored_at
            return labels
        state = tuple(found)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "edges")
        common.discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        tied = tied.select("a", F.col("m").alias("b")).unionByName(tied.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stored(tied.distinct(), "edges")
        common.discard(large)


def different_bits(name: str, longs: int) -> Column:
    """Bits in which the sketches of both sides of a pair differ."""
    return sum((F.bit_count(F.col(f"{name}{k}_a").bitwiseXOR(F.col(f"{name}{k}_b"))) for k in range(1, longs)), F.bit_count(F.col(f"{name}0_a").bitwiseXOR(F.col(f"{name}0_b"))))


def may_be_similar(s: Settings) -> Column:
    """What sizes and sketches of the two nodes of a pair leave possible. Sets as similar as asked differ in at most
    (100 - similar) / (100 + similar) of the sum of their sizes."""
    sets_allow = different_bits("parity", s.set_longs) * (100 + s.similar) <= (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - s.similar)
    samples_allow = different_bits("sketch", s.sketch_longs) <= most_different_bits(s)
    return sets_allow & samples_allow


def side(nodes: DataFrame, x: str, s: Settings) -> DataFrame:
    """Nodes as one side of a pair, with the words of their sketches as plain columns."""
    sketches = [F.col(name)[k].alias(f"{name}{k}_{x}") for name, longs in (("parity", s.set_longs), ("sketch", s.sketch_longs)) for k in range(longs)]
    return nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_shingles_{x}"), *sketches)


def sketched(pairs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """Pairs whose sketches allow them to be similar enough."""
    return pairs.join(side(nodes, "a", s), "a").join(side(nodes, "b", s), "b").where(may_be_similar(s)).select("a", "b")


def tiles(members: DataFrame, s: Settings) -> DataFrame:
    """Members of bands dealt to tiles: a band of many members is split into shards, and every two shards meet in one tile,
    so no task holds more than two shards of a band."""
    shards = F.ceil(F.col("n") / s.tile).cast("int")
    shard = F.pmod(F.xxhash64("node", F.lit(7)), shards).cast("int")
    dealt = members.withColumn("shard", shard).withColumn("other", F.explode(F.sequence(F.lit(0), shards - 1)))
    dealt = dealt.select("key", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "node", "label", "n_shingles", "keys", "parity", "sketch")
    return dealt.repartition(common.partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def close_pairs(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """(larger node, smaller node) of the pairs of a tile with different labels that their sketches leave possible.
    A pair that shares several bands comes out of the first of them only."""
    held: list[tuple[np.ndarray, ...]] = []
    tile = None
    for batch in batches:
        flat = [np.asarray(batch.column(k)) for k in range(7)]
        words = [np.asarray(batch.column(k).flatten()).view(np.uint64).reshape(len(batch), -1) for k in (7, 8, 9)]
        at = np.stack(flat[:3], axis=1)
        cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)]) if len(batch) else []
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            if held and tuple(at[a]) != tile:
                yield from pairs_of_tile(tile, held, s)
                held = []
            tile = tuple(at[a])
            held.append(tuple(x[a:b] for x in (*flat[3:], *words)))
    if held:
        yield from pairs_of_tile(tile, held, s)


def pairs_of_tile(tile: tuple, held: list, s: Settings) -> Iterator[pa.RecordBatch]:
    shard, node, label, size, keys, parity, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
    left, right = np.flatnonzero(shard == tile[1]), np.flatnonzero(shard == tile[2])
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        differ = np.zeros((len(rows), len(right)), np.int32)
        for k in range(parity.shape[1]):
            differ += np.bitwise_count(parity[rows, k][:, None] ^ parity[right, k][None, :])
        able = differ * (100 + s.similar) <= (size[rows][:, None] + size[right][None, :]) * (100 - s.similar)
        a, b = np.nonzero(able & (label[rows][:, None] != label[right][None, :]))
        a, b = rows[a], right[b]
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= most_different_bits(s)
        a, b = a[near], b[near]
        shared = (keys[a] == keys[b]).argmax(axis=1)
        here = keys[a, shared] == np.int64(tile[0]).view(np.uint64)
        a, b = node[a[here]], node[b[here]]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def grouped(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: row (``common.row_key``), doc_id, n_shingles, label: rows of one component have one label,
    documents without shingles none."""
    s = settings
    spark = documents.sparkSession
    common.on_workers(spark)
    kinds = "row long, doc_id long, n_shingles long, node long, keys array<long>, sketch array<long>, parity array<long>"
    docs = stored(rows_of(documents).mapInArrow(lambda b: described(b, s), kinds), "described")
    nodes = stored(docs.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", "n_shingles", "keys", "sketch", "parity"), "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    met = stored(banded.join(shared.select("key", "center"), "key"), "shared-bands")
    first = stored(sketched(met.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct(), nodes, s), "first-pairs")
    edges = links(documents, docs, first, s)
    labels = components(edges)

    placed = met.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
    across = tiles(placed.join(mixed, "key").join(nodes, "node"), s).mapInArrow(lambda b: close_pairs(b, s), "a long, b long")
    done = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = across.distinct().join(done, ["a", "b"], "left_anti")
    second = stored(second, "second-pairs")
    if not second.isEmpty():
        more, before = links(documents, docs, second, s), labels
        labels = components(edges.unionByName(more))
        for table in (more, before):
            common.discard(table)
    for table in (nodes, met, first, second, edges):
        common.discard(table)
    return docs.select("row", "doc_id", "n_shingles", "node").join(labels, "node", "left").select("row", "doc_id", "n_shingles", F.coalesce("label", "node").alias("label"))


def near_duplicates(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows have one set and so one component.
    Rows without a doc_id are linked like any others, and different texts under one id each by their own; such rows are
    kept only if no row of their component has an id, and that component has a null id. Other columns are ignored; an
    empty table gives an empty result.
    """
    labelled = grouped(documents, settings)
    smallest = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    out = labelled.join(smallest, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def representatives(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents``, with all their columns, that stand for their component: the one with the smallest
    doc_id (no id comes last), of several texts under it the one with the smallest key; a repeated row once. Rows without
    shingles are linked with nothing and stay, a repeated one once."""
    labelled = grouped(documents, settings)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    best = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    kept = best.unionByName(labelled.where("label IS NULL").select("row")).distinct()
    keyed = documents.withColumn("_row", common.row_key())
    return keyed.join(kept.withColumnRenamed("row", "_row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*documents.columns)
