import json
import pathlib

import pytest
from pyspark.sql import functions as F

from formgrain import families
from formgrain.operators import annotate, labels, lines, merging, places, splitting
from formgrain.plans import evaluation, process, profile, review
from formgrain.streaming import live

from .goldens import BOARDING_LINES, GOLDENS, box

AS_OF = "2026-01-01"


@pytest.fixture(scope="module")
def golden_docs(make_docs):
    return make_docs([(name, plugin, body) for name, (plugin, body, _) in GOLDENS.items()])


@pytest.fixture(scope="module")
def processed(golden_docs):
    return process.process(golden_docs, as_of=AS_OF).cache()


def test_golden_regression(spark, processed, tmp_path):
    """All golden documents through the job, scored, totalled and reported."""
    rows = [(name, {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                    for k, v in expected.items()}) for name, (_, _, expected) in GOLDENS.items()]
    golden = spark.createDataFrame(rows, "doc_id string, expected map<string,string>")
    compared = evaluation.compare(golden, processed.select("doc_id", "plugin", "field_values", "accepted"))
    scored = evaluation.document_scores(compared)
    assert [(r.doc_id, r.outcome) for r in scored.collect() if r.status != "pass"] == []
    row = evaluation.totals(scored).first()
    expected = sum(len(e) for _, _, e in GOLDENS.values())
    assert (row.num_fixtures, row.num_failed, row.num_fields, row.num_matched_fields, row.status) == (
        len(GOLDENS), 0, expected, expected, "pass")
    evaluation.write_report("parser_regression", evaluation.totals(scored), scored, str(tmp_path / "report"),
                            F.lit("2026-01-01").cast("timestamp"), ocr_backend="inline")
    head = spark.read.json(str(tmp_path / "report" / "header")).first()
    assert (head.report_name, head.totals.num_fixtures, head.runner.ocr_backend) == ("parser_regression", len(GOLDENS), "inline")
    assert spark.read.json(str(tmp_path / "report" / "results")).count() == len(GOLDENS)


def test_empty_golden_fails_and_no_golden_passes(spark):
    one = spark.createDataFrame([("d", {}, None)], "doc_id string, expected map<string,string>, x int").drop("x")
    predicted = spark.createDataFrame([("d", "p", {"a": "1"})], "doc_id string, plugin string, field_values map<string,string>")
    scored = evaluation.document_scores(evaluation.compare(one, predicted))
    assert (scored.first().status, scored.first().field_exact_match_rate) == ("fail", 0.0)
    assert evaluation.totals(scored.limit(0)).first().status == "pass"


def test_run_writes_everything_once(spark, golden_docs, tmp_path):
    out = str(tmp_path / "out")
    done = process.run(spark, golden_docs, out, "r1", as_of=AS_OF)
    assert done.count() == len(GOLDENS)
    letters = spark.read.json(f"{out}/dead_letters")
    rejected = {r.doc_id for r in done.where("not accepted").collect()}
    assert {r.sample_id for r in letters.collect()} == rejected and "id_back" in rejected
    process.run(spark, golden_docs, out, "r1", as_of=AS_OF)
    assert spark.read.json(f"{out}/dead_letters").count() == len(rejected)
    notes = {r.sample_id: r for r in spark.read.parquet(f"{out}/annotations").collect()}
    assert [r.region_id for r in notes["boarding_inline"].regions] == [f"r{i + 1}" for i in range(len(BOARDING_LINES))]
    assert notes["passport_text"].regions == []


def test_bytes_are_noted_not_stored(spark, tmp_path):
    letters = spark.createDataFrame([("d", "p", b"abc")], "doc_id string, plugin string, content binary")
    process.write_dead_letters(letters, str(tmp_path), "r")
    row = spark.read.json(str(tmp_path)).first()
    assert (row.content.type, row.content.size) == ("bytes", 3)


def test_letters_take_a_fraction_of_their_text(spark, make_docs, tmp_path):
    docs = make_docs([(f"d{i}", ["receipt", "passport"][i % 2], [(f"line {i * j}", 0.9, box(i, j, i + 60, j + 10)) for j in range(9)]) for i in range(400)])
    letters = process.dead_letters(process.process(docs, as_of=AS_OF, keep_unrouted=True)).cache()
    process.write_dead_letters(letters, str(tmp_path / "out"), "r")
    files = list((tmp_path / "out").rglob("part-*"))
    text = letters.drop("plugin").select(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert letters.count() == 400 and 0 < sum(f.stat().st_size for f in files) < text / 4
    stored = spark.read.schema(letters.schema).json(str(tmp_path / "out"))
    assert stored.select(*letters.columns).orderBy("doc_id").collect() == letters.orderBy("doc_id").collect()
    process.write_dead_letters(letters, str(tmp_path / "out"), "r", compression="none")
    plain = list((tmp_path / "out").rglob("part-*"))
    assert sum(f.stat().st_size for f in plain) == text and all(f.suffix == ".json" for f in plain)


def test_letters_outlive_the_intake(spark, sf_dir):
    from formgrain.session import shared_dir
    from formgrain.suite import queries
    scratch = pathlib.Path(shared_dir(spark, "x")).parent
    left = set(scratch.glob("intake-*/results"))
    letters = queries.live_dead_letters(spark, sf_dir)
    assert set(scratch.glob("intake-*/results")) == left
    wanted = queries.process.dead_letters(queries.process.process(queries.mixed_results(spark, sf_dir), as_of=AS_OF, keep_unrouted=True))
    wanted = wanted.select("doc_id", "plugin", F.size("issues").alias("num_issues"))
    assert letters.count() > 0 and letters.exceptAll(wanted).count() == 0 and wanted.exceptAll(letters).count() == 0


def test_overrides_win_even_when_null(spark, make_docs):
    docs = make_docs([("d", "passport", GOLDENS["passport_lines"][1]), ("e", "passport", GOLDENS["passport_lines"][1])])
    given = spark.createDataFrame([("d", "passport_number", "OLD", 1), ("d", "passport_number", "X", 2), ("d", "surname", None, 1),
                                   ("e", "mrz_lines", '["A"]', 1)], "doc_id string, field string, value string, seq int")
    rows = {r.doc_id: r for r in process.family_job(docs, "passport", given, AS_OF).collect()}
    assert rows["d"].fields.surname is None and rows["d"].fields.passport_number == "X"
    assert [i.code for i in rows["d"].issues] == ["passport_number_mismatch"]
    assert [i.code for i in rows["e"].issues] == ["missing_mrz_lines"]


def test_unknown_family_is_kept_apart_and_custom_families_plug_in(make_docs):
    docs = make_docs([("d", "receipt", ["x"]), ("e", "china_id", ["x"])])
    assert [r.doc_id for r in process.unroutable(docs).collect()] == ["d"]
    families.register(families.Family("receipt", None))
    try:
        row = process.process(docs, only=["receipt"]).first()
        assert row.accepted and row.issues == [] and row.field_values == {"doc_type": "receipt"}
    finally:
        families._FAMILIES.pop("receipt")


def test_annotation_keeps_blank_lines(make_docs):
    row = annotate.annotate(make_docs([("in/scan.7.png", "china_id", [("a", 0.5, box(1, 2, 3, 4)), "  "])])).first()
    assert row.sample_id == "scan.7" and [r.text for r in row.regions] == ["a", "  "]
    assert row.regions[0].bbox.asDict() == {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}
    assert [(f.field_name, f.region_id) for f in row.fields] == [("ocr_line_1", "r1"), ("ocr_line_2", "r2")]


def test_decisions_review_and_causes(processed):
    decided = {r.doc_id: r.decision for r in review.with_decision(processed).select("doc_id", "decision").collect()}
    assert decided["id_front"] == "review"  # its lines carry no score
    assert decided["boarding_inline"] == "accept" and decided["train_text"] == "reject"
    queue = {r.doc_id: r for r in review.review_queue(review.with_decision(processed)).collect()}
    name = [e for e in queue["id_front"].evidence if e.field == "name"][0]
    assert name.value == "张三" and [c.line_no for c in name.candidates] == [2]
    causes = {(r.code, r.root_cause) for r in review.failures_by_cause(process.issue_rows(processed)).collect()}
    assert ("missing_ticket_number", "parser_error") in causes and ("checksum_invalid", "ocr_error") in causes
    top = review.top_failures(process.issue_rows(processed), 1).collect()
    assert [(r.code, r.rank) for r in top] == [("checksum_invalid", 1)]


def test_line_table_operators_match_the_nested_ones(spark, make_docs):
    docs = make_docs([("a", "hukou_booklet", GOLDENS["booklet_labels_alone"][1]), ("b", "hukou_booklet", GOLDENS["booklet_member"][1]),
                      ("c", "hukou_booklet", ["姓名:", "x", "NAME: y", "户号"])])
    from formgrain import rules
    aliases = spark.createDataFrame(labels.alias_pairs(rules.BOOKLET_ALIASES), "alias string, field string")
    flat = {(r.doc_id, r.field): r.value for r in labels.label_values_of_lines(lines.explode_lines(docs), aliases).collect()}
    nested = {}
    for r in lines.with_rows(docs).select("doc_id", labels.labelled_values(F.col("rows"), rules.BOOKLET_ALIASES).alias("v")).collect():
        for v in r.v:
            nested.setdefault((r.doc_id, v.field), v.value)
    assert flat == nested and flat[("c", "member_name")] == "x" and ("c", "household_id") not in flat


def test_foreign_lines_are_not_broadcast(spark, make_docs):
    from formgrain import rules
    docs = make_docs([("a", "p", ["姓名", "Li", "户号: 1"]), ("b", "p", ["户号", "2"]), ("c", "p", ["姓名"])])
    aliases = spark.createDataFrame(labels.alias_pairs(rules.BOOKLET_ALIASES), "alias string, field string")
    done = labels.label_values_of_lines(lines.explode_lines(docs).drop("next_text"), aliases)
    assert {tuple(r) for r in done.select("doc_id", "field", "value").collect()} == {("a", "member_name", "Li"), ("a", "household_id", "1"), ("b", "household_id", "2")}
    planned = done._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in line and "doc_id" in line for line in planned.splitlines())


def test_aliases_must_be_unambiguous():
    with pytest.raises(ValueError):
        labels.alias_pairs({"a": ["x"], "b": ["X"]})
    with pytest.raises(ValueError):
        labels.alias_pairs({"a": ["x:y"]})


def test_routes_and_nearest_on_line_tables(spark, make_docs):
    gazetteer = spark.createDataFrame([("FUZHOU",), ("TAIYUAN",)], "token string")
    docs = make_docs([("a", "p", ["TAI YUAN", "fuzhou", "TAIYUAN"]), ("b", "p", ["FUZHOU", "FUZHOU"])])
    routes = {r.doc_id: (r.departure, r.arrival) for r in places.place_route_of_lines(lines.explode_lines(docs), gazetteer).collect()}
    assert routes == {"a": ("TAIYUAN", "FUZHOU"), "b": ("FUZHOU", None)}


def test_positional_split_is_exact(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), "id", F.lit(1).alias("one"))
    for ratio in (0.0, 0.1, 0.5, 0.8, 0.999, 1.0):
        split = splitting.positional_split(df, "k", ratio)
        train = [r.k for r in split.where("split = 'train'").collect()]
        every = sorted(r.k for r in df.collect())
        assert sorted(train) == every[: int(5000 * ratio)]
    with pytest.raises(ValueError):
        splitting.positional_split(df, "one", 0.5)
    with pytest.raises(ValueError):
        splitting.positional_split(df, "one", 0.5, "one")
    tied = splitting.positional_split(df, "one", 0.5, "id").where("split = 'train'")
    assert sorted(r.id for r in tied.collect()) == list(range(2500))
    two = splitting.positional_split(spark.createDataFrame([("a",), ("b",)], "k string"), "k", 0.5)
    assert {r.k: r.split for r in two.collect()} == {"a": "train", "b": "val"}


@pytest.mark.parametrize("train", range(6))
def test_positional_split_places_nulls_first_and_ties_by_id(spark, train):
    rows = [(None, 5), (None, 2), ("a", 9), ("a", 1), ("b", 3)]
    split = splitting.positional_split(spark.createDataFrame(rows, "k string, i int"), "k", train / 5, "i")
    order = [2, 5, 1, 9, 3]
    assert {r.i for r in split.where("split = 'train'").collect()} == set(order[:train])


def test_every_document_comes_out_of_the_run(spark, make_docs, tmp_path):
    docs = make_docs([("a", "passport", ["x"]), ("b", "receipt", "some text"), ("c", None, ["y"])])
    out = str(tmp_path / "out")
    done = process.run(spark, docs, out, "r1", as_of=AS_OF)
    assert {r.doc_id for r in done.collect()} == {"a", "b", "c"}
    letters = {r.doc_id: r for r in spark.read.json(f"{out}/dead_letters").collect()}
    assert (letters["b"].issues[0].code, letters["b"].text, letters["c"].issues[0].code) == ("unknown_plugin", "some text", "missing_plugin")
    process.run(spark, make_docs([("z", "receipt", "t")]), out, "r1", as_of=AS_OF)
    assert {r.doc_id for r in spark.read.json(f"{out}/dead_letters").collect()} == {"z"}


def test_letters_of_streams_stay_apart(spark, make_docs, tmp_path):
    for name in ("one", "two"):
        source = str(tmp_path / name)
        process.with_contract(make_docs([(name, "receipt", "t")])).write.json(source)
        stream = live.process_stream(live.read_results_stream(spark, source, multi_line=False), as_of=AS_OF)
        live.dead_letter_stream(stream, str(tmp_path / "dead"), str(tmp_path / f"ck-{name}"), once=True).awaitTermination()
    assert {r.doc_id for r in spark.read.json(str(tmp_path / "dead")).collect()} == {"one", "two"}


def test_unknown_overrides_are_kept(spark, make_docs):
    docs = make_docs([("d", "passport", GOLDENS["passport_lines"][1])])
    given = spark.createDataFrame([("d", "surname", "NEW"), ("d", "visa", "V1"), ("d", None, "lost")], "doc_id string, field string, value string")
    row = process.process(docs, given, AS_OF, only=["passport"]).first()
    assert (row.field_values["surname"], row.field_values["visa"], row.parsed_fields["surname"]) == ("NEW", "V1", "ERIKSSON")


def test_unmatched_golden_keeps_its_family(spark):
    golden = spark.createDataFrame([("d", "p", {"a": "1"}), ("e", "p", {"a": "1"})], "doc_id string, plugin string, expected map<string,string>")
    predicted = spark.createDataFrame([("d", "p", {"a": "1"}, True, "accept")], "doc_id string, plugin string, field_values map<string,string>, accepted boolean, decision string")
    row = evaluation.quality_metrics(evaluation.compare(golden, predicted)).first()
    assert (row.plugin, row.num_documents, row.document_success_rate, row.review_rate) == ("p", 2, 0.5, 0.5)


def test_dataset_summary(spark):
    df = spark.createDataFrame([("china_id",), ("train_ticket",), ("china_id",), (None,)], "doc_type string")
    row = splitting.dataset_summary(df).first()
    assert (row.num_samples, row.doc_types) == (4, ["china_id", "train_ticket", "unknown"])
    shares = splitting.hash_split(spark.range(10000), "id", 0.8).groupBy("split").count().collect()
    assert abs({r.split: r["count"] for r in shares}["train"] - 8000) < 300


def test_profile_summary(spark):
    df = spark.createDataFrame([("a", "x", 0.5, 2), ("a", "y", 0.75, 3), ("b", "x", 1.0, 4)],
                               "category string, kind string, confidence double, num_lines int")
    got = {(r.grouped_by, r["name"]): (r["count"], r.avg_confidence, r.avg_num_lines) for r in profile.summary(df).collect()}
    assert got == {("category", "a"): (2, 0.625, 2.5), ("category", "b"): (1, 1.0, 4.0),
                   ("kind", "x"): (2, 0.75, 3.0), ("kind", "y"): (1, 0.75, 3.0)}


def test_pairing_sources_and_quality(spark, make_docs):
    docs = make_docs([("f1", "china_id", GOLDENS["id_front"][1]), ("f2", "china_id", GOLDENS["id_front"][1]), ("b1", "china_id", GOLDENS["id_back"][1])])
    cards = families.extract(docs, families.get("china_id")).withColumn("case_id", F.lit("c"))
    row = merging.pair_sides(cards).first()
    assert (row.front.doc_id, row.back.doc_id, row.num_fronts, row.warnings) == ("f1", "b1", 2, ["repeated_front"])
    results = spark.createDataFrame([("d", "n", "A", 0.9, "vlm_fallback"), ("d", "n", "B", 0.2, "manual")],
                                    "doc_id string, field string, value string, confidence double, source string")
    assert merging.select_by_source(results).first().value == "B"
    scores = spark.createDataFrame([("boarding_pass", {"blur": 0.6, "shadow": 0.9}), ("hukou_booklet", {"shadow": 0.9})],
                                   "plugin string, quality map<string,double>")
    got = {r.plugin: (r.route, r.passed, r.reasons) for r in review.quality_route(scores).collect()}
    assert got == {"boarding_pass": ("enhanced", False, ["blur"]), "hukou_booklet": ("review", False, ["shadow"])}


def test_stream_equals_batch(spark, golden_docs, processed, tmp_path):
    source = str(tmp_path / "in")
    process.with_contract(golden_docs).write.json(source)
    stream = live.process_stream(live.read_results_stream(spark, source, multi_line=False), as_of=AS_OF)
    picked = stream.select("doc_id", "field_values", "accepted", "score")
    live.write_stream(picked, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    got = {r.doc_id: (r.field_values, r.accepted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.doc_id: (r.field_values, r.accepted) for r in processed.collect()}

    query = live.dead_letter_stream(stream, str(tmp_path / "dead"), str(tmp_path / "ck2"), once=True)
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "dead")).count() == sum(not a for _, a in got.values())


def test_windowed_rates_and_repeats(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "p", m % 2 == 0, "accept" if m % 2 == 0 else "review") for h in range(5) for m in range(0, 60, 7)]
    batch = spark.createDataFrame(rows, "ts string, plugin string, accepted boolean, decision string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    live.write_stream(live.decision_rates(stream, "ts"), str(tmp_path / "rates"), str(tmp_path / "ck"), once=True).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "rates")).collect()}
    every = {tuple(r) for r in live.decision_rates(batch, "ts").collect()}
    assert closed and closed <= every and len(every) - len(closed) <= 2

    ups = spark.range(2000).select((F.col("id") % 100).alias("sample_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id") % 7)).alias("ts"))
    ups.write.parquet(str(tmp_path / "ups"))
    once = live.drop_repeats(spark.readStream.schema(ups.schema).parquet(str(tmp_path / "ups")), "ts")
    live.write_stream(once, str(tmp_path / "once"), str(tmp_path / "ck3"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).groupBy("sample_id").count().where("count > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "once")).count() == 100 == live.first_uploads(ups, "ts").count()


def test_plans(spark, golden_docs):
    """Extraction moves nothing; evaluation joins documents once; label joins broadcast by size only."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(process.process(golden_docs, as_of=AS_OF))
    assert "EvalPython" not in plan(process.process(golden_docs, as_of=AS_OF))


def test_mixed_documents_are_scanned_once(spark, make_docs, golden_docs, tmp_path):
    """One scan for all families and the unrouted; with overrides one join; the rows are those of family after family."""
    more = make_docs([("x", "receipt", ["x"]), ("y", None, "text"), ("z", "passport", None)])
    golden_docs.unionByName(more).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = process.process(docs, as_of=AS_OF, keep_unrouted=True)
    assert (plan(whole).count("FileScan"), plan(whole).count("Exchange"), plan(whole).count("Union")) == (1, 0, 0)
    given = spark.createDataFrame([("id_front", "name", "X"), ("id_front", "extra", "1"), ("x", "name", "kept"), ("medical_inline", "diagnosis", '["D"]'), ("z", "surname", None)],
                                  "doc_id string, field string, value string")
    given.write.parquet(str(tmp_path / "given"))
    merged = process.process(docs, spark.read.parquet(str(tmp_path / "given")), AS_OF, keep_unrouted=True)
    assert (plan(merged).count("FileScan"), plan(merged).count("Join "), plan(merged).count("Union")) == (2, 1, 0)
    for overrides, rows in ((None, whole), (given, merged)):
        found = {r.doc_id: r for r in rows.collect()}
        assert len(found) == len(GOLDENS) + 3
        for name in families.names():
            apart = process.family_job(process.with_contract(docs), name, overrides, AS_OF)
            apart = apart.select("doc_id", "issues", "accepted", "score", families.as_text_map(apart).alias("field_values")).collect()
            for r in apart:
                values = {k: v for k, v in found[r.doc_id].field_values.items() if k != "extra"}
                assert (r.issues, r.accepted, r.score, r.field_values) == (found[r.doc_id].issues, found[r.doc_id].accepted, found[r.doc_id].score, values)
        assert [i.code for k in "xy" for i in found[k].issues] == ["unknown_plugin", "missing_plugin"]
    assert found["id_front"].field_values["name"] == "X" and found["id_front"].field_values["extra"] == "1" and found["id_front"].parsed_fields["name"] == "张三"
    assert found["x"].field_values == {"name": "kept"} and found["z"].parsed_fields["surname"] is None


def test_families_read_by_a_function_keep_their_rows_apart(make_docs):
    docs = make_docs([("d", "receipt", ["total 5"]), ("e", "china_id", ["x"]), ("f", "other", ["x"])])
    read = lambda rows: rows.withColumn("fields", F.struct(F.get("rows", 0)["text"].alias("line")))
    families.register(families.Family("receipt", read))
    try:
        rows = {r.doc_id: r for r in process.process(docs, keep_unrouted=True).collect()}
        assert rows.keys() == {"d", "e", "f"} and rows["d"].accepted and rows["d"].field_values == {"line": "total 5"}
        some = process.process(docs, only=["receipt"], keep_unrouted=True).collect()
        assert sorted(r.doc_id for r in some) == ["d", "f"]
        assert [r.doc_id for r in process.process(docs, only=["receipt"]).collect()] == ["d"]
    finally:
        families._FAMILIES.pop("receipt")
