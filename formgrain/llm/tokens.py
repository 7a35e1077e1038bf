"""Token counts of a byte-level BPE tokenizer by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Tier one is a compact table of the most frequent pre-tokens, packed into one broadcast value of bounded size. What it
lacks is encoded once per worker and remembered there (tier two). Merges never cross pre-tokens, so the sum of
their lengths is the length of the text. The table is drawn from a bounded sample of documents: it decides how fast
a length is found, never what it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formgrain.llm import common

#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_ROWS = 65_536
SAMPLE_DOCUMENTS = 10_000
LONGEST_IN_TABLE = 64
#: Below, both libraries' character tables agree; above, they may be of different Unicode versions.
SETTLED = "\u0500"
CACHED = 300_000


class Lengths(dict):
    """Tier one as the dictionary itself; tier two behind its misses."""

    def __init__(self, path: str, table: bytes):
        pieces, offsets, lengths = common.unpack(table)
        text = pieces.tobytes()
        super().__init__((text[a:b].decode(), n) for a, b, n in zip(offsets[:-1], offsets[1:], lengths.tolist(), strict=True))
        self.tokenizer = Tokenizer.from_file(path)
        self.remembered: dict[str, int] = {}
        special = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special or t.content]
        if any(t.lstrip or t.rstrip or t.single_word for t in special):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.special = regex.compile("|".join(regex.escape(t.content) for t in sorted(special, key=lambda t: -len(t.content)))) if special else None
        self.find = regex.compile(PRE_TOKENS).findall
        self.unsettled = regex.compile(f"[^\\x00-{SETTLED}]").search
        self.odd: dict[str, bool] = {}

    def __missing__(self, piece: str) -> int:
        n = self.remembered.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(self.remembered) < CACHED and len(piece) <= LONGEST_IN_TABLE:
                self.remembered[piece] = n
        return n

    def is_odd(self, c: str) -> bool:
        """Does the tokenizer class a character otherwise than the pattern here?"""
        if c not in self.odd:
            probe = f"a{c}a1{c}1.{c}. {c}"
            self.odd[c] = [m.span() for m in regex.finditer(PRE_TOKENS, probe)] != [s for _, s in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        return self.odd[c]

    def count(self, text: str) -> int:
        if self.unsettled(text) and any(c > SETTLED and self.is_odd(c) for c in set(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.count(p) for p in parts)


@lru_cache(2)
def lengths_of(path: str, table: bytes) -> Lengths:
    return Lengths(path, table)


def packed(pieces: list[str], lengths: list[int]) -> bytes:
    raw = [p.encode() for p in pieces]
    return common.pack(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64), np.array(lengths, np.int32))


def counted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    find = regex.compile(PRE_TOKENS).findall
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(p for p in find((text or b"").decode("utf-8", "replace")) if len(p) <= LONGEST_IN_TABLE)
            if len(counts) > 8 * TABLE_ROWS:
                counts = Counter(dict(counts.most_common(2 * TABLE_ROWS)))
    top = counts.most_common(TABLE_ROWS)
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])


def frequent_lengths(documents: DataFrame, path: str, rows: int = TABLE_ROWS, sample: int = SAMPLE_DOCUMENTS) -> bytes:
    """The packed table of at most ``rows`` pre-tokens and their lengths, from about ``sample`` documents."""
    texts = common.texts_of(documents)
    few = texts.sample(min(1.0, sample / max(1, documents.count())), 11).select("text").mapInArrow(counted_pieces, "piece string, n long")
    top = few.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "piece").limit(rows).select("piece").collect()
    empty = Lengths(path, packed([], []))
    pieces = [r.piece for r in top]
    return packed(pieces, [empty[p] for p in pieces])


def counted(batches: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    lengths = lengths_of(path, table.value)
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([lengths.count(t.decode("utf-8", "replace")) for t in texts], pa.int64()),
        ], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path``: a byte-level BPE file of the tokenizers library, at the same place on every worker. Null and empty texts
    have 0 bytes and tokens. A special string inside a text counts as its one token. Whole texts are counted;
    repeated rows and null doc_ids are counted like any others; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    common.on_workers(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(documents, path))
    rows = common.texts_of(documents).mapInArrow(lambda b: counted(b, path, table), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
