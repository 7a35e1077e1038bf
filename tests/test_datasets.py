import json

from pyspark.sql import functions as F

from formgrain import shared_dir
from formgrain.functions import text
from formgrain.operators import lines, merging
from formgrain.plans import process, profile, review
from formgrain.sources import datasets

from .goldens import GOLDENS


def test_asset_profile_from_files(spark, make_docs, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"12345")
    files = datasets.read_files(spark, str(tmp_path / "img"))
    found = files.first().path
    (tmp_path / "manifest.json").write_text(json.dumps({"name": "n", "version": "0.2.0", "source": "s", "samples": [
        {"sample_id": "a", "category": "doc", "kind": "document", "path": found, "size_bytes": 5},
        {"sample_id": "b", "category": "doc", "kind": "document", "path": "nowhere.png"}]}), encoding="utf-8")
    assets = datasets.read_assets(spark, str(tmp_path / "manifest.json"))
    assert {r.version for r in assets.collect()} == {"0.2.0"}
    seen = make_docs([("a", "x", [("one", 0.5), ("two", 1.0)])]).withColumnRenamed("doc_id", "sample_id").withColumn("text", F.lit("t" * 200))
    done, errors = profile.asset_results(datasets.asset_facts(assets, files), seen)
    row = done.first()
    assert (row.size_bytes, row.num_lines, row.confidence, len(row.text_preview), row.status) == (5, 2, 0.75, 120, "ok")
    assert [(r.sample_id, r.error) for r in errors.collect()] == [("b", "missing_file")]
    totals = profile.totals(done, errors).first()
    assert (totals.num_samples, totals.num_processed, totals.num_errors, totals.status) == (2, 1, 1, "fail")


def test_manifest_paths_meet_scanned_files(spark, make_docs, tmp_path):
    folder = tmp_path / "a b" / "资料"
    folder.mkdir(parents=True)
    for name in ("one.png", "two 2.png", "三.png", "left out.png"):
        (folder / name).write_bytes(name.encode())
    given = [("1", f"{folder}/one.png"), ("2", "资料/two 2.png"), ("3", "./资料//三.png"), ("4", f"file://{folder}/one.png"), ("5", "资料/none.png")]
    assets = spark.createDataFrame([(i, "c", "k", p) for i, p in given], "sample_id string, category string, kind string, path string")
    files = datasets.read_files(spark, str(tmp_path / "a b"))
    root = str(tmp_path / "a b")
    facts = {r.sample_id: (r.found_bytes, r.error) for r in datasets.asset_facts(assets, files, root).collect()}
    assert facts == {"1": (7, None), "2": (9, None), "3": (7, None), "4": (7, None), "5": (None, "missing_file")}
    assert [r.sample_id for r in datasets.missing_assets(assets, files, root).collect()] == ["5"]
    seen = make_docs([("1", "x", ["t"])]).withColumnRenamed("doc_id", "sample_id").withColumn("text", F.lit("t"))
    done, errors = profile.asset_results(datasets.asset_facts(assets, files, root), seen)
    assert done.count() == 1
    assert {r.sample_id: r.error for r in errors.collect()} == {"2": "not_recognised", "3": "not_recognised", "4": "not_recognised", "5": "missing_file"}


def test_malformed_manifests(spark):
    texts = ["{broken", '{"name": 1}', '{"samples": []}', "[]", '[{"sample_id": "a"}]', '{"samples": [{"sample_id": "b"}]}', None]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = [(r.value, r.error) for r in datasets.malformed_manifests(df).collect()]
    assert got == list(zip([*texts[:4], None], ["not_json", "no_samples", "empty_samples", "empty_samples", "not_json"]))


def test_candidates_prefer_the_valid_number(make_docs):
    docs = lines.with_rows(make_docs([
        ("a", "p", [("身份证号: 110101199003074515", 0.5), ("110101199003074514", 0.9)]),
        ("b", "p", [("ID Number", 0.5), ("1101 0119 9003 0745 14", 0.5), ("310101199003074514", 0.9)]),
        ("c", "p", ["none"]),
    ]))
    chosen = review.choose_candidate(review.number_candidates(docs, F.lit("2026-01-01").cast("date")))
    got = {r.doc_id: r.chosen for r in chosen.collect()}
    assert got == {"a": "110101199003074514", "b": "110101199003074514", "c": None}


def test_completeness_counts_empty_lists_as_missing(make_docs):
    docs = make_docs([("a", "medical_record", ["姓名: x", "诊断: y"]), ("b", "medical_record", ["姓名: z"])])
    done = {r.field: (r.num_documents, r.num_present) for r in review.completeness(process.process(docs)).collect()}
    assert done["patient_name"] == (2, 2) and done["diagnosis"] == (2, 1) and done["medications"] == (2, 0)


def test_long_fields_and_vocabularies(spark, make_docs):
    docs = process.process(make_docs([("a", "passport", GOLDENS["passport_lines"][1])]))
    long = {r.field: r.value for r in merging.fields_long(docs).collect()}
    assert long["surname"] == "ERIKSSON" and json.loads(long["mrz_fields"])["sex"] == "F"
    bad = merging.unknown_values(spark.createDataFrame([("mrz",), ("magic",), (None,)], "source string"), "source", ["mrz"])
    assert {r.source for r in bad.collect()} == {"magic", None}


def test_text_functions(spark):
    cases = spark.createDataFrame([("/x/a.b.png",), ("plain",), (".hidden",), (None,)], "p string")
    assert [r.s for r in cases.select(text.file_stem(F.col("p")).alias("s")).collect()] == ["a.b", "plain", ".hidden", "in_memory_sample"]
    dates = {"2012年7月9日": "2012-07-09", "x 2012/07/9 y": "2012-07-09", "2012.7.9": "2012-07-09", "12-7-9": None,
             "2012年7月9日生": None, "２０１２-７-９": "2012-07-09", "12012-7-9": None}
    df = spark.createDataFrame(list(dates.items()), "t string, want string")
    assert [r for r in df.select("t", "want", text.iso_date(F.col("t")).alias("got")).collect() if r.want != r.got] == []
    blanks = spark.createDataFrame([("\u3000 a \t\u00a0b \x1f",)], "t string")
    row = blanks.select(text.strip(F.col("t")).alias("s"), text.compact(F.col("t")).alias("c"),
                        text.squeeze_upper(text.strip(F.col("t"))).alias("q")).first()
    assert (row.s, row.c, row.q) == ("a \t\u00a0b", "ab", "A B")


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
