"""Recognition results: scanning them and normalising engine payloads."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structs import pinned
from ..session import on_workers

OCR_SCHEMA = (
    "doc_id string, plugin string, engine string, text string, "
    "lines array<struct<box:array<array<double>>,text:string,score:double>>, confidence double"
)


MALFORMED = "_malformed"


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = True, keep_malformed: bool = False) -> DataFrame:
    """Results stored as Parquet (bulk) or JSON. Partition bulk data by ``plugin``: family filters then prune.

    JSON that does not parse gives a row without a value. With ``keep_malformed`` its text is kept in the column
    ``_malformed``, for :func:`split_malformed`.
    """
    return results_reader(spark.read, fmt, multi_line, keep_malformed).load(path)


def results_reader(reader, fmt: str, multi_line: bool, keep_malformed: bool):
    """A batch or stream reader of recognition results."""
    reader = reader.format(fmt)
    if fmt != "json":
        return reader.schema(OCR_SCHEMA)
    reader = reader.option("multiLine", multi_line)
    if keep_malformed:
        return reader.option("columnNameOfCorruptRecord", MALFORMED).schema(f"{OCR_SCHEMA}, {MALFORMED} string")
    return reader.schema(OCR_SCHEMA)


def split_malformed(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results that parsed and name a document, and letters ``(doc_id, plugin, error, raw)`` for the others.

    ``malformed_json`` is text that is no JSON or does not fit the schema, in full; ``missing_doc_id`` is JSON that no
    document can be told for. Whatever could be read of a letter stands beside its text.
    """
    broken, nameless = F.col(MALFORMED).isNotNull(), F.col("doc_id").isNull()
    whole = F.to_json(F.struct(*[c for c in results.columns if c != MALFORMED]))
    letters = results.where(broken | nameless).select(
        "doc_id", "plugin", F.when(broken, F.lit("malformed_json")).otherwise(F.lit("missing_doc_id")).alias("error"),
        F.coalesce(MALFORMED, whole).alias("raw"),
    )
    return results.where(~broken & ~nameless).drop(MALFORMED), letters


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _score(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0))


def _items(v: Column) -> Column:
    """Elements of a JSON list, null for anything else."""
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _box(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<array<double>>")


def _line_type(box: Column, text: Column, score: Column) -> Column:
    return F.struct(box.alias("box"), text.alias("text"), score.alias("score"))


def _paged(pages: Column) -> Column:
    """Pages of parallel arrays; texts without score or box keep 0.0 and null."""

    def page_lines(page: Column) -> Column:
        texts = _items(F.try_variant_get(page, "$.rec_texts", "variant"))
        scores = _items(F.try_variant_get(page, "$.rec_scores", "variant"))
        first = _items(F.try_variant_get(page, "$.dt_polys", "variant"))
        second = _items(F.try_variant_get(page, "$.rec_polys", "variant"))
        boxes = F.when(F.size(first) > 0, first).otherwise(second)
        return F.coalesce(
            F.transform(
                texts,
                lambda t, i: _line_type(_box(F.get(boxes, i)), _text(t), _score(F.get(scores, i))),
            ),
            F.array().cast("array<struct<box:array<array<double>>,text:string,score:double>>"),
        )

    return F.flatten(F.transform(pages, page_lines))


def _listed(raw: Column) -> Column:
    """``[box, [text, score]]`` items, possibly inside a one-page list; other items are dropped."""
    only = _items(F.get(raw, 0))
    items = F.when((F.size(raw) == 1) & only.isNotNull(), only).otherwise(raw)

    def line(item: Column) -> Column:
        parts = _items(item)
        payload = F.get(parts, 1)
        pair = _items(payload)
        text = (
            F.when(F.size(pair) > 0, _text(F.get(pair, 0)))
            .when(_is_string(payload), _text(payload))
            .otherwise(F.lit(""))
        )
        score = F.when(F.size(pair) > 1, _score(F.get(pair, 1))).otherwise(F.lit(0.0))
        return F.when(F.size(parts) >= 2, _line_type(_box(F.get(parts, 0)), text, score))

    return F.filter(F.transform(items, line), lambda x: x.isNotNull())


def normalize_payloads(df: DataFrame, payload: str = "payload", engine: str = "unknown") -> DataFrame:
    """Turn raw engine output (JSON text) into ``lines``, ``text`` and ``confidence``.

    Both payload shapes are handled in place, row by row; nothing is exploded or shuffled.
    Text that is no JSON gives no lines and ``payload_ok`` false.
    """
    staged = pinned(df, {"_raw": F.try_parse_json(F.col(payload))})
    staged = pinned(staged, {"_list": _items(F.col("_raw"))})
    raw = F.col("_list")
    empty = F.array().cast("array<struct<box:array<array<double>>,text:string,score:double>>")
    lines = F.coalesce(F.when(_is_object(F.get(raw, 0)), _paged(raw)).otherwise(_listed(raw)), empty)
    staged = pinned(staged, {"lines": lines})
    total = F.aggregate("lines", F.lit(0.0), lambda acc, l: acc + l["score"])
    count = F.size("lines")
    return (
        staged.withColumn("engine", F.lit(engine))
        .withColumn("text", F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))
        .withColumn("confidence", F.when(count > 0, total / count).otherwise(F.lit(0.0)))
        .withColumn("payload_ok", F.col(payload).isNull() | F.col("_raw").isNotNull())
        .drop("_raw", "_list")
    )


RECOGNISED_SCHEMA = f"{OCR_SCHEMA}, error string"
PAYLOAD_SCHEMA = "doc_id string, plugin string, engine string, payload string, error string"
#: Results are handed on when so many images are done.
ENGINE_ROWS = 64


def _recognised(result: dict) -> tuple:
    """Text, lines and mean score as the engine told them; anything else than a dict of lists of dicts is an error."""
    lines = [{"box": line.get("box"), "text": line.get("text"), "score": line.get("score")} for line in result.get("lines") or []]
    return result.get("text"), lines, float(result.get("confidence") or 0.0)


def _payload(result) -> tuple:
    return (result if isinstance(result, str) else json.dumps(result, ensure_ascii=False),)


def _engine_rows(batches, make_engine, engine: str, read: Callable, width: int):
    """One row per image: what ``read`` makes of the engine's result, or the error that either of them raised."""
    infer = make_engine()
    for batch in batches:
        for start in range(0, len(batch), ENGINE_ROWS):
            rows = []
            for doc_id, plugin, content in batch.iloc[start:start + ENGINE_ROWS].itertuples(index=False):
                values, error = (None,) * width, None
                try:
                    if not content:
                        raise ValueError("empty content")
                    values = read(infer(content))
                except Exception as failure:  # any failure of a foreign engine concerns this image only
                    error = f"{type(failure).__name__}: {failure}"
                rows.append((doc_id, plugin, engine, *values, error))
            yield rows


def run_engine(images: DataFrame, make_engine, engine: str = "custom") -> DataFrame:
    """Recognise ``images(doc_id, plugin, content)`` with a caller's engine; one row per image, with ``error``.

    ``make_engine()`` runs once per Python task and returns a function from bytes to a dict with ``text``, ``lines`` and
    ``confidence``. An image on which it fails, or whose result is no such dict, gets the error's text and no result; the
    task goes on. An engine that cannot be made fails the job. How many images a task holds at once is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``; set it to a few for large images.
    """

    def recognise(batches):
        for rows in _engine_rows(batches, make_engine, engine, _recognised, 3):
            yield pandas.DataFrame(rows, columns=["doc_id", "plugin", "engine", "text", "lines", "confidence", "error"])

    on_workers(images.sparkSession)
    return images.select(F.col("doc_id").cast("string"), "plugin", "content").mapInPandas(recognise, RECOGNISED_SCHEMA)


def run_layout_engine(images: DataFrame, make_engine, engine: str = "custom") -> DataFrame:
    """The same for an engine that returns a layout as JSON text, or as lists and dicts: ``payload`` for ``flatten_layout``
    or ``normalize_payloads``, with ``error``."""

    def recognise(batches):
        for rows in _engine_rows(batches, make_engine, engine, _payload, 1):
            yield pandas.DataFrame(rows, columns=["doc_id", "plugin", "engine", "payload", "error"])

    on_workers(images.sparkSession)
    return images.select(F.col("doc_id").cast("string"), "plugin", "content").mapInPandas(recognise, PAYLOAD_SCHEMA)


def split_failures(recognised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results, and letters ``(doc_id, plugin, engine, error)`` for images whose recognition failed. Store what the engine
    returned before splitting it, or the engine runs once for each half."""
    good = recognised.where("error IS NULL").drop("error")
    return good, recognised.where("error IS NOT NULL").select("doc_id", "plugin", "engine", "error")
