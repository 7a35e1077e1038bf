"""The document job: route, extract, merge, validate, decide, annotate, store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import families
from ..functions.structs import pinned, unfold
from ..functions.text import file_stem, message_of
from ..operators.annotate import annotate
from ..operators.lines import LINES_TYPE, line_stats, with_rows
from ..operators.merging import apply_overrides, merged_struct, override_maps
from ..sources import ocr


def with_contract(results: DataFrame) -> DataFrame:
    """Fill in the optional columns of recognition results."""
    have = set(results.columns)
    for name, kind in (("text", "string"), ("lines", LINES_TYPE), ("engine", "string"), ("confidence", "double")):
        if name not in have:
            results = results.withColumn(name, F.lit(None).cast(kind))
    return results


def unroutable(results: DataFrame) -> DataFrame:
    """Documents whose family nobody registered."""
    return results.where(F.col("plugin").isNull() | ~F.col("plugin").isin(families.names()))


def family_job(results: DataFrame, name: str, overrides: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
    """Typed result of one family: ``fields`` struct, ``issues``, ``accepted`` and ``score``."""
    family = families.get(name)
    docs = families.extract(results.where(F.col("plugin") == name), family)
    if overrides is not None:
        docs = docs.withColumn("parsed_fields", families.as_text_map(docs))
    return families.validate(apply_overrides(docs, overrides), family, as_of)


def own(name: str) -> str:
    """The column that holds the fields of one family."""
    return f"_of_{name}"


def by_family(names: list[str], value: Callable[[str], Column]) -> Column:
    """The value of the row's own family; the others are not computed. Null for a family not named."""
    branches = F.when(F.lit(False), F.lit(None))
    for name in names:
        branches = branches.when(F.col("plugin") == name, value(name))
    return branches


def read_by_family(docs: DataFrame, names: list[str]) -> DataFrame:
    """Documents with ``rows`` and one struct (``own``) for each family, null but for the row's own.

    Stages of all families advance together, so the documents are scanned once however many families there are, and
    each row passes through its own family's expressions only.
    """
    readings = {name: families.get(name).columns() for name in names}
    staged = with_rows(docs)
    made: set[str] = set()
    for level in range(max((len(r.stages) for r in readings.values()), default=0)):
        at_level: dict[str, list[str]] = {}
        for name, reading in readings.items():
            for stage in reading.stages[level:level + 1]:
                for column in stage:
                    at_level.setdefault(column, []).append(name)
        columns = {}
        for column, users in at_level.items():
            value = by_family(users, lambda name: readings[name].stages[level][column])
            columns[column] = value.otherwise(F.col(column)) if column in made else value
        staged = staged.withColumns(columns)
        made |= set(columns)
    fields = {own(name): by_family([name], lambda name: F.struct(*[v.alias(k) for k, v in readings[name].fields.items()])) for name in names}
    return pinned(staged, fields).drop(*made)


NO_VALUES = "map<string,string>"


def unrouted_issues() -> Column:
    """What is wrong with a document that no registered family takes."""
    code = F.when(F.col("plugin").isNull(), F.lit("missing_plugin")).otherwise(F.lit("unknown_plugin"))
    issue = F.struct(F.lit(1).alias("seq"), code.alias("code"), message_of(code).alias("message"), F.lit("error").alias("severity"), F.lit("plugin").alias("field"))
    return F.array(issue).cast(families.ISSUES_TYPE)


def job(results: DataFrame, names: list[str], overrides: DataFrame | None, as_of: str | None, keep_unrouted: bool) -> DataFrame:
    """The job's rows for families that are read as columns: one scan, and one join if there are overrides."""
    known = F.col("plugin").isin(names)
    docs = read_by_family(results if keep_unrouted else results.where(known), names)
    texts = lambda frame: by_family(names, lambda name: families.as_text_map(frame, own(name)))
    nothing = F.create_map().cast(NO_VALUES)
    if overrides is None:
        docs = docs.withColumn("parsed_fields", F.lit(None).cast(NO_VALUES)).withColumn("provided", nothing)
    else:
        docs = docs.withColumn("parsed_fields", F.coalesce(texts(docs), nothing)).join(override_maps(overrides), "doc_id", "left")
        merged = {name: merged_struct(docs, own(name)) for name in names}
        unknown = by_family(names, lambda name: merged[name][1])
        docs = pinned(docs.withColumn("provided", F.coalesce(unknown, "overrides", nothing)), {own(name): by_family([name], lambda name: merged[name][0]) for name in names})
    issues = by_family(names, lambda name: families.issues_of(families.get(name).rules, as_of, own(name))).otherwise(unrouted_issues())
    docs = pinned(docs, {"issues": issues}).withColumn("accepted", ~families.has_severity(F.col("issues"), "error"))
    score = by_family(names, lambda name: (families.get(name).score or families.strict_score)(F.col("accepted"), F.col("issues")))
    return docs.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("field_values", F.map_concat(F.coalesce(texts(docs), nothing), "provided"))


def job_columns(done: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    count, mean = line_stats(F.col("lines"))
    return done.select(
        *keep, "doc_id", "plugin", file_stem(F.col("doc_id").cast("string")).alias("sample_id"), "field_values", "parsed_fields", "issues", "accepted", "score",
        F.coalesce("confidence", mean).alias("confidence"), count.alias("num_lines"), "text", "lines",
    )


def branch(results: DataFrame, name: str, overrides: DataFrame | None, as_of: str | None, keep: tuple[str, ...]) -> DataFrame:
    """The job's rows of one family that is read by a function over whole tables."""
    done, nothing = family_job(results, name, overrides, as_of), F.create_map().cast(NO_VALUES)
    values = families.as_text_map(done)
    if overrides is None:
        return job_columns(done.withColumn("field_values", values).withColumn("parsed_fields", F.lit(None).cast(NO_VALUES)), keep)
    return job_columns(done.withColumn("field_values", F.map_concat(values, F.coalesce("provided", nothing))), keep)


def process(
    results: DataFrame,
    overrides: DataFrame | None = None,
    as_of: str | None = None,
    only: list[str] | None = None,
    keep_unrouted: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """All families over one table of recognition results, one row per document, with the columns ``keep`` of the input.

    ``field_values`` has the provided values in place of parsed ones, also those of fields the family does not know;
    ``parsed_fields`` has what was read before. ``keep_unrouted`` adds the documents of no registered family as
    rejected rows, so that every document of the input is in the result.

    The input is scanned once: each row is led through the expressions of its own family. Without overrides nothing is
    shuffled; with them the documents join once, on ``doc_id``. Only a family that brings its own ``extract`` function
    instead of a ``reading`` is read by a scan of its own.
    """
    results = with_contract(results)
    names = only or families.names()
    apart = [name for name in names if families.get(name).extract]
    together = [name for name in names if name not in apart]
    rest = results
    elsewhere = [name for name in families.names() if name not in together]
    if keep_unrouted and elsewhere:
        rest = results.where(F.col("plugin").isNull() | ~F.col("plugin").isin(elsewhere))
    branches = [job_columns(job(rest, together, overrides, as_of, keep_unrouted), keep)] if together or keep_unrouted else []
    return reduce(DataFrame.unionByName, branches + [branch(results, name, overrides, as_of, keep) for name in apart])


def issue_rows(processed: DataFrame) -> DataFrame:
    return unfold(processed, "issues", "doc_id", "plugin").select("doc_id", "plugin", "item.*")


def decisions(processed: DataFrame) -> DataFrame:
    return processed.select("doc_id", "plugin", "accepted", "score", F.size("issues").alias("num_issues"))


def dead_letters(processed: DataFrame) -> DataFrame:
    """Documents that were not accepted, with everything needed to look into them."""
    return processed.where(~F.coalesce("accepted", F.lit(False))).select(
        "doc_id", "plugin", "sample_id", "field_values", F.coalesce("parsed_fields", "field_values").alias("parsed_fields"),
        "issues", "score", "confidence", "text", "lines",
    )


def bytes_note(content: Column) -> Column:
    """What stands in for raw bytes in a stored record."""
    return F.struct(F.lit("bytes").alias("type"), F.length(content).alias("size"))


def write_dead_letters(letters: DataFrame, path: str, run_id: str, compression: str = "gzip") -> None:
    """Store one run's dead letters as JSON by family; running the same run again replaces all of them.

    As plain text, letters take many times the room of the results they tell of: names, numbers of boxes and texts recur.
    They are compressed at the codec's fastest level. Spark's JSON reader opens such files by their name;
    ``compression="none"`` writes plain text for readers that do not.
    """
    if "content" in letters.columns:
        letters = letters.withColumn("content", bytes_note(F.col("content")))
    writer = letters.write.mode("overwrite").partitionBy("plugin").option("zlib.compress.level", "BEST_SPEED")
    writer.json(f"{path.rstrip('/')}/run_id={run_id}", compression=compression)


def run(
    spark: SparkSession,
    results: DataFrame,
    out: str,
    run_id: str,
    overrides: DataFrame | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """Process once into a table under ``out`` and derive every other output from that table.

    The written table cuts the lineage: losing executors later does not repeat extraction. It holds every document;
    those of no registered family are rejected and end up with the dead letters.
    """
    target = f"{out.rstrip('/')}/processed/run_id={run_id}"
    process(results, overrides, as_of, keep_unrouted=True).write.mode("overwrite").partitionBy("plugin").parquet(target)
    processed = spark.read.parquet(target)
    base = f"{out.rstrip('/')}"
    issue_rows(processed).write.mode("overwrite").parquet(f"{base}/issues/run_id={run_id}")
    annotate(processed, F.col("sample_id")).write.mode("overwrite").parquet(f"{base}/annotations/run_id={run_id}")
    write_dead_letters(dead_letters(processed), f"{base}/dead_letters", run_id)
    return processed


def recognise(images: DataFrame, make_engine, out: str, run_id: str, engine: str = "custom") -> DataFrame:
    """Recognise every image once into a table under ``out``; returns the results, ready for :func:`run`.

    Images on which the engine failed are stored with the run's letters, one file set per family; a re-run replaces both.
    """
    base = out.rstrip("/")
    target = f"{base}/recognised/run_id={run_id}"
    ocr.run_engine(images, make_engine, engine).write.mode("overwrite").parquet(target)
    good, failed = ocr.split_failures(images.sparkSession.read.schema(ocr.RECOGNISED_SCHEMA).parquet(target))
    write_dead_letters(failed, f"{base}/recognition_letters", run_id)
    return good
