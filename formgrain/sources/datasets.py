"""Manifests, asset files, golden fixtures and labelling exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_TYPE = (
    "struct<sample_id:string,doc_type:string,image_path:string,"
    "annotation_path:string,split:string,tags:array<string>>"
)
REQUIRED_KEYS = ["sample_id", "doc_type", "image_path"]
ASSET_TYPE = (
    "struct<sample_id:string,category:string,path:string,kind:string,source_path:string,"
    "source_url:string,size_bytes:bigint,sha256:string,license:string,benchmark_track:string>"
)


def manifest_samples(documents: DataFrame, column: str = "value") -> DataFrame:
    """Samples of manifest texts: ``{"samples": [...]}`` or a bare list."""
    wrapped = F.from_json(column, f"struct<samples:array<{SAMPLE_TYPE}>>")["samples"]
    bare = F.from_json(column, f"array<{SAMPLE_TYPE}>")
    is_list = F.startswith(F.ltrim(F.col(column)), F.lit("["))
    return documents.select(F.explode(F.when(is_list, bare).otherwise(wrapped)).alias("s")).select("s.*")


def malformed_manifests(documents: DataFrame, column: str = "value") -> DataFrame:
    """Manifest texts that give no samples, with the reason: ``not_json``, ``no_samples`` or ``empty_samples``."""
    parsed = F.try_parse_json(column)
    listed = F.coalesce(F.try_variant_get(parsed, "$.samples", "array<variant>"), F.try_variant_get(parsed, "$", "array<variant>"))
    reason = (
        F.when(parsed.isNull(), F.lit("not_json")).when(listed.isNull(), F.lit("no_samples"))
        .when(F.size(listed) == 0, F.lit("empty_samples"))
    )
    return documents.withColumn("error", reason).where(F.col("error").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_samples(spark.read.text(path, wholetext=True))


def build_manifest(samples: DataFrame, name: str, version: str = "0.1.0") -> tuple[DataFrame, DataFrame]:
    """Typed manifest rows, and the rows that lack a required key with the names of those keys."""
    have = set(samples.columns)
    typed = samples.select(
        *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c)
          for c in (*REQUIRED_KEYS, "annotation_path", "split")],
        F.coalesce(F.col("tags") if "tags" in have else F.lit(None).cast("array<string>"),
                   F.array().cast("array<string>")).alias("tags"),
    )
    gone = F.filter(
        F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in REQUIRED_KEYS]), lambda k: k.isNotNull()
    )
    checked = typed.withColumn("missing_keys", gone)
    good = checked.where(F.size("missing_keys") == 0).drop("missing_keys")
    bad = checked.where(F.size("missing_keys") > 0)
    return good.withColumn("name", F.lit(name)).withColumn("version", F.lit(version)), bad


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Asset manifest rows with the manifest's name and version."""
    schema = f"name string, version string, source string, samples array<{ASSET_TYPE}>"
    return (
        spark.read.schema(schema).option("multiLine", True).json(path)
        .select("name", "version", "source", F.explode("samples").alias("s"))
        .select("name", "version", "source", "s.*")
    )


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files as ``(path, size_bytes, content)``, found at any depth."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size_bytes"), "content")


def path_key(path: Column, root: str | None = None) -> Column:
    """One spelling of a path: relative ones under ``root``, no ``file:`` scheme, no empty or ``.`` parts."""
    if root is not None:
        absolute = path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
        path = F.when(absolute, path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.regexp_replace(F.regexp_replace(plain, "(?<!:)/(\\./|/)+", "/"), "^\\./", "")


def asset_facts(assets: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """Every asset with the measured size and digest of its file, or error ``missing_file``.

    ``root``: the folder that relative manifest paths start from. Digests are taken before the join, so file contents
    are never shuffled.
    """
    measured = files.select(
        path_key(F.col("path"), root).alias("_key"), F.col("size_bytes").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256")
    )
    return assets.withColumn("_key", path_key(F.col("path"), root)).join(measured, "_key", "left").drop("_key").withColumn(
        "error", F.when(F.col("found_sha256").isNull(), F.lit("missing_file"))
    )


def missing_assets(assets: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    there = files.select(path_key(F.col("path"), root).alias("_key"))
    return (
        assets.withColumn("_key", path_key(F.col("path"), root)).join(there, "_key", "left_anti")
        .select("sample_id", "path", F.lit("missing_file").alias("error"))
    )


FIXTURE_SCHEMA = (
    "plugin string, sample string, "
    "ocr_result struct<text:string,lines:array<struct<text:string,score:double,box:array<array<double>>>>>, "
    "expected_fields string"
)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Golden fixtures: one document per file with its expected fields as JSON text."""
    return (
        spark.read.schema(FIXTURE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
        .select(
            F.col("_metadata.file_path").alias("doc_id"),
            "plugin",
            F.coalesce("sample", F.lit("<inline_ocr_result>")).alias("sample"),
            F.col("ocr_result.text").alias("text"),
            F.transform(
                "ocr_result.lines",
                lambda l: F.struct(l["box"].alias("box"), l["text"].alias("text"), l["score"].alias("score")),
            ).alias("lines"),
            F.col("ocr_result").isNotNull().alias("has_ocr"),
            expected_map(F.col("expected_fields")).alias("expected"),
        )
    )


def expected_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def expected_fields(golden: DataFrame) -> DataFrame:
    """Long rows (doc_id, field, expected) of golden documents; lists stay JSON text."""
    return golden.select("doc_id", F.explode("expected").alias("field", "expected"))


def label_studio_rows(exports: DataFrame, column: str = "value") -> DataFrame:
    return exports.select(F.lit("label_studio").alias("source"), F.try_parse_json(column).alias("raw"))


def intake_verdicts(uploads: DataFrame, known: list[str]) -> DataFrame:
    """Add ``status`` and ``reason`` to uploads ``(plugin, content)``: only status 200 goes on.

    A missing plugin comes first, then an unknown one, then an empty payload.
    """
    plugin, content = F.col("plugin"), F.col("content")
    return uploads.withColumn(
        "status",
        F.when(plugin.isNull(), 422).when(~plugin.isin(known), 404)
        .when(content.isNull() | (F.octet_length(content) == 0), 400).otherwise(200),
    ).withColumn(
        "reason",
        F.when(plugin.isNull(), F.lit("missing_plugin")).when(~plugin.isin(known), F.lit("unknown_plugin"))
        .when(content.isNull() | (F.octet_length(content) == 0), F.lit("empty_file")),
    )
