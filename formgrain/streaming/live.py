"""Streams through the same extraction and validation as the batch job."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.process import bytes_note, dead_letters, process, write_dead_letters
from ..sources.datasets import intake_verdicts
from ..sources.ocr import results_reader

SALTS = 32


def read_results_stream(
    spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 1000, multi_line: bool = True, keep_malformed: bool = False
) -> DataFrame:
    """Result files as they arrive: by default one JSON document per file, else one per line. With ``keep_malformed``
    text that does not parse is kept for ``ocr.split_malformed``, which takes streams as well."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    return results_reader(reader, fmt, multi_line, keep_malformed).load(path)


def process_stream(results: DataFrame, as_of: str | None = None, only: list[str] | None = None) -> DataFrame:
    """The batch job's projections need no state, so a stream takes them as they are. Documents of no registered
    family come out rejected, unless ``only`` some families are asked for."""
    return process(results, as_of=as_of, only=only, keep_unrouted=only is None)


def drop_repeats(uploads: DataFrame, event_time: str, key: str = "sample_id", within: str = "1 hour") -> DataFrame:
    """First upload per key within the watermark delay.

    A key that makes up much of the stream is first reduced in salted shares, spread over tasks
    by the hash of its event time, and then across the shares.
    """
    salted = uploads.withColumn("_salt", F.pmod(F.xxhash64(event_time), F.lit(SALTS)))
    return (
        salted.withWatermark(event_time, within)
        .dropDuplicatesWithinWatermark([key, "_salt"])
        .dropDuplicatesWithinWatermark([key])
        .drop("_salt")
    )


def first_uploads(uploads: DataFrame, event_time: str, key: str = "sample_id") -> DataFrame:
    """Batch twin of :func:`drop_repeats` over all time: the earliest upload per key, combined before the shuffle."""
    rest = [c for c in uploads.columns if c not in (key, event_time)]
    return (
        uploads.groupBy(key).agg(F.min(F.struct(event_time, *rest)).alias("first")).select(key, "first.*")
    )


def latest_of(uploads: DataFrame, event_time: str, key: str) -> DataFrame:
    """The row with the latest event time of each key; of equally late ones the greatest. Combined before the shuffle."""
    rest = [c for c in uploads.columns if c not in (key, event_time)]
    last = uploads.groupBy(key).agg(F.max(F.struct(event_time, *rest)).alias("last")).select(key, "last.*")
    return last.select(*uploads.columns)


def latest_upload_stream(uploads: DataFrame, event_time: str, path: str, checkpoint: str, key: str = "sample_id", once: bool = False) -> StreamingQuery:
    """Uploads replace earlier ones of their name, however late each arrives: :func:`read_latest` gives the state.

    Every micro-batch is reduced to one row per key and written as a version of its own; a replayed batch replaces its
    own version. The stream keeps no state, so its cost follows the batch and not the number of names ever seen.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_of(batch, event_time, key).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return _started(uploads, store, checkpoint, once)


def read_latest(spark: SparkSession, path: str, schema, event_time: str, key: str = "sample_id") -> DataFrame:
    """The last upload of every name over all versions."""
    versions = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    return latest_of(versions, event_time, key)


def compact_latest(spark: SparkSession, path: str, target: str, schema, event_time: str, key: str = "sample_id") -> None:
    """Fold all versions under ``path`` into one row per name in another folder, from where a later stream can go on."""
    read_latest(spark, path, schema, event_time, key).write.mode("overwrite").parquet(f"{target}/version=folded")


def read_uploads_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """Uploaded files as they arrive in a folder per family: ``(path, plugin, size_bytes, content)``. A file that lies in no
    folder of a family has no plugin. Spark's file sources pass over files without a byte: where empty uploads must be
    answered, stream upload rows (from a table or a queue) into :func:`intake_stream` instead."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    folder = F.regexp_extract("path", "/plugin=([^/]*)/[^/]*$", 1)
    return reader.load(path).select("path", F.when(folder != "", folder).alias("plugin"), F.col("length").alias("size_bytes"), "content")


def intake_stream(uploads: DataFrame, known: list[str], accepted: str, rejected: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Judge uploads ``(plugin, content, ...)`` as they arrive: those with status 200 go on with their content, the others are
    stored with status, reason and size instead of it, by status.

    Both sinks are written per micro-batch, from one evaluation of it; a replayed batch replaces its own files in both.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = intake_verdicts(batch, known).persist()
        try:
            judged.where("status = 200").drop("status", "reason").write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
            noted = judged.where("status <> 200").withColumn("content", bytes_note(F.col("content")))
            noted.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        finally:
            judged.unpersist()

    return _started(uploads, store, checkpoint, once)


def _started(stream: DataFrame, store, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def decision_rates(decided: DataFrame, event_time: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Accepted and reviewed shares per family in tumbling windows. Works on batches and streams alike."""
    source = decided.withWatermark(event_time, delay) if decided.isStreaming else decided
    return (
        source.groupBy(F.window(event_time, width), "plugin")
        .agg(
            F.count(F.lit(1)).alias("num_documents"),
            F.count(F.when(F.col("accepted"), 1)).alias("num_accepted"),
            F.count(F.when(F.col("decision") == "review", 1)).alias("num_review"),
        )
        .select(
            F.col("window.start").alias("window_start"), "plugin", "num_documents", "num_accepted", "num_review",
        )
    )


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def dead_letter_stream(processed: DataFrame, path: str, checkpoint: str, once: bool = False, stream_id: str | None = None) -> StreamingQuery:
    """Store dead letters per micro-batch. A batch that is replayed replaces its own files, and no other stream's:
    they are kept under ``stream_id``, by default a name made from the checkpoint."""
    stream_id = stream_id or hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        write_dead_letters(dead_letters(batch), path, f"{stream_id}-batch-{batch_id}")

    return _started(processed, store, checkpoint, once)
