"""Benchmark passages in documents, by a distributed positional inverted index. DataFrame functions only.

Texts are split into words once. The corpus counts of all benchmark terms say which terms of a passage are rarest. The
index stores the postings of those terms: term, row, position. A passage's two rarest terms are looked up, their
position lists are shifted by the terms' offsets and intersected; what is left is gathered per row, and the row's own
words confirm the other terms. No words but the terms themselves go through an exchange before that.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formgrain.functions.structs import unfold
from formgrain.llm.common import row_key, stored

WINDOW = 10
#: Bytes of benchmark terms or passages, as measured, up to which they are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words with A-Z in lower case and all else as it is; null has none."""
    whole = F.col(text).cast("string")
    ascii_only = F.octet_length(whole) == F.length(whole)
    lowered = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def bytes_of(df: DataFrame, column: str) -> int:
    """Bytes of a column of words, or of arrays of words, with 64 for each row and word."""
    text = F.col(column) if dict(df.dtypes)[column] == "string" else F.concat_ws(" ", column)
    words_ = F.lit(1) if dict(df.dtypes)[column] == "string" else F.size(column)
    return df.agg(F.coalesce(F.sum(F.octet_length(text) + 64 * (words_ + 1)), F.lit(0))).first()[0]


def passages(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, passage): every ``window`` consecutive words, or all words of a shorter item."""
    items = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", k + 1, window))).alias("passage")).distinct()


class Index:
    """Positional index of ``documents`` for the passages of ``benchmark``; tables are kept in the shared folder. ``row``
    numbers the documents' rows, whatever their doc_ids."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        self.window = window
        numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), words("text").alias("words"))
        self.documents = stored(numbered, "words")
        self.items = stored(passages(benchmark, window), "passages")
        self.passages = stored(self._ranked(), "ranked-passages")
        self.size = bytes_of(self.passages, "passage") * 3
        self.postings = stored(self._postings(), "postings")

    def _ranked(self) -> DataFrame:
        """Passages whose terms all occur, with (count, offset, term) of their terms, rarest first."""
        terms = self.items.select(F.explode("passage").alias("term")).distinct()
        size = bytes_of(terms, "term")
        counts = self.documents.select(F.explode("words").alias("term")).join(small(terms, size), "term").groupBy("term").agg(F.count("*").alias("n"))
        counts = small(stored(counts, "term-counts"), size)
        parts = self.items.select("passage").distinct().select("passage", F.posexplode("passage").alias("offset", "term"))
        ranked = parts.join(counts, "term").groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms"))
        return ranked.where(F.size("terms") == F.size("passage")).select("passage", "terms")

    def _postings(self) -> DataFrame:
        """(term, row, position) of the two rarest terms of any passage."""
        terms = self.passages.select(F.explode(F.slice("terms", 1, 2)).alias("t")).select("t.term").distinct()
        placed = self.documents.select("row", F.posexplode("words").alias("position", "term"))
        return placed.join(small(terms, self.size), "term").select("term", "row", "position")

    def starts(self, rank: int) -> DataFrame:
        """Postings of the passages' rank-th rarest terms, shifted by the terms' offsets."""
        term = F.col("terms")[rank - 1]
        looked_up = self.passages.where(F.size("terms") >= rank).select(term["term"].alias("term"), term["offset"].alias("offset"), "passage")
        return self.postings.join(small(looked_up, self.size), "term").select("row", "position", (F.col("position") - F.col("offset")).alias("start"), "passage")

    def at_home(self, found: DataFrame, *columns: str) -> DataFrame:
        """Rows of documents with what was found in each, as the array ``found`` of ``columns``: as many entries as the
        document has places that may match, and each document once. Only the words of such documents are exchanged."""
        gathered = stored(found.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("found")), "places")
        rows = gathered.select("row")
        return self.documents.join(small(rows, 64 * rows.count()), "row", "left_semi").join(gathered, "row")

    def phrases(self) -> DataFrame:
        """Exact matches: (passage, row, start)."""
        key = F.xxhash64("passage").alias("of")
        rarest = self.starts(1).where("start >= 0").select("row", "start", "passage", key)
        second = self.starts(2).where("start >= 0").select("row", "start", key).distinct()
        both = rarest.where(F.size("passage") > 1).join(second, ["row", "start", "of"], "left_semi")
        maybe = both.unionByName(rarest.where(F.size("passage") == 1))
        whole = F.filter("found", lambda c: F.slice("words", c["start"] + 1, F.size(c["passage"])) == c["passage"])
        home = self.at_home(maybe, "start", "passage")
        return unfold(home, whole, "row", "doc_id").select("item.passage", "row", "doc_id", "item.start")

    def near(self, least: float = 0.8) -> DataFrame:
        """Proximity matches: (passage, row, doc_id, position, share). At least that share of a passage's different terms,
        in any order, stands within window - 1 words of its rarest term at ``position``."""
        reach = self.window - 1

        def judged(c: Column) -> Column:
            first = F.greatest(c["position"] - reach, F.lit(0))
            around = F.slice("words", first + 1, c["position"] - first + 1 + reach)
            share = F.size(F.array_intersect(around, c["passage"])) / F.size(F.array_distinct(c["passage"]))
            return F.struct(c["passage"].alias("passage"), c["position"].alias("position"), share.alias("share"))

        shares = F.filter(F.transform("found", judged), lambda c: c["share"] >= least)
        home = self.at_home(self.starts(1), "position", "passage")
        return unfold(home, shares, "row", "doc_id").select("item.passage", "row", "doc_id", "item.position", "item.share")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``documents``: row, doc_id, key (``common.row_key``), n_words; and n_hit, n_items, items if it has hits."""
    index = Index(documents, benchmark, window)
    hits = stored(index.phrases(), "phrase-hits")
    in_order = Window.partitionBy("row").orderBy("start")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.groupBy("row", "start").agg((F.col("start") + F.max(F.size("passage"))).alias("end"))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0)))
    covered = covered.groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "passage").distinct().join(index.items, "passage").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    counted = index.documents.select("row", "doc_id", "key", F.size("words").cast("long").alias("n_words"))
    return counted.join(covered.join(named, "row"), "row", "left")


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurrences of passages), n_items (items with an
    occurring passage), items_sha256 (of their ids, sorted as strings, comma-joined), contaminated (n_hit > 0).

    Null and empty texts have no words; null and empty items have no passages. Every row is judged by its own text: rows
    without a doc_id, rows that share one, and repeated rows alike. Repeated items count once. Other columns are
    ignored. Empty documents give an empty result, an empty benchmark no hits.
    """
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return contamination(documents, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.col("items"), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no passage of the benchmark, each judged by its own text."""
    found = contamination(documents, benchmark, window).where("n_hit > 0").select(F.col("key").alias("_row")).distinct()
    return documents.withColumn("_row", row_key()).join(found, "_row", "left_anti").select(*documents.columns)
