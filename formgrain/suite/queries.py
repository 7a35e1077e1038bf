"""Registered queries: every operator over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import families, rules
from ..families import china_id, passport
from ..functions.geometry import bounding_box
from ..functions.structs import unfold
from ..functions.text import file_stem, iso_date
from ..operators import annotate as annotating
from ..operators import candidates, labels, lines, merging, places, splitting
from ..plans import evaluation, process, profile, registry, review
from ..session import remove_dir, shared_dir
from ..sources import datasets, layout, ocr
from ..streaming import live
from . import render
from .render import table


def as_of() -> Column:
    return F.lit(render.AS_OF).cast("date")


# --- scanning and normalising ----------------------------------------------------------------


def ocr_lines(spark, sf):
    return lines.explode_lines(render.texts(spark, sf)).select("doc_id", "line_no", "text")


def line_profile(spark, sf):
    count, mean = lines.line_stats(F.col("lines"))
    return render.text_results(spark, sf).select(
        "doc_id", count.alias("num_lines"), F.round(mean, 9).alias("confidence"),
        F.substring("text", 1, 120).alias("preview"),
    )


def _payloads(spark, sf) -> DataFrame:
    """Engine output as JSON text: listed lines for odd keys (some in a page list), pages for even ones."""
    k, score = F.col("p_partkey"), F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    box = F.lit("[[0,0],[9,0],[9,5],[0,5]]")
    listed = F.concat(
        F.lit("[["), box, F.lit(',["'), F.col("p_name"), F.lit('",'), score, F.lit(']],[null,["'), F.col("p_brand"),
        F.lit('","?"]],["junk"],7]'),
    )
    paged = F.concat(
        F.lit('[{"rec_texts":["'), F.col("p_name"), F.lit('","'), F.col("p_brand"), F.lit('"],"rec_scores":['), score,
        F.lit('],"dt_polys":[],"rec_polys":['), box, F.lit(']},{"rec_texts":["'), F.col("p_type"), F.lit('"]}]'),
    )
    wrapped = F.when(k % 4 == 1, F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed)
    return render.spread(table(spark, sf, "part")).select(k.alias("doc_id"), F.when(k % 2 == 1, wrapped).otherwise(paged).alias("payload"))


def payload_lines(spark, sf):
    done = ocr.normalize_payloads(_payloads(spark, sf))
    return unfold(done, "lines", "doc_id", numbered=True).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), F.col("item.text").alias("text"), F.col("item.score").alias("score"),
        bounding_box(F.col("item.box"))["x2"].alias("right_edge"),
    )


def payload_documents(spark, sf):
    return ocr.normalize_payloads(_payloads(spark, sf)).select(
        "doc_id", "text", F.round("confidence", 9).alias("confidence"), "payload_ok"
    )


def layout_fields(spark, sf):
    payload = F.to_json(
        F.struct(
            F.col("role"),
            F.array(F.struct(F.col("text"), ((F.col("turn") % 4) * F.lit(0.25)).alias("score"))).alias("content"),
            F.struct(F.col("role").alias("key"), F.col("text").alias("value")).alias("pair"),
        )
    )
    turns = render.spread(table(spark, sf, "conversations")).select("conv_id", "turn", payload.alias("payload"))
    return layout.flatten_layout(turns).select(
        "conv_id", "turn", "text", F.get(F.map_keys("kv"), 0).alias("kv_key"), F.get(F.map_values("kv"), 0).alias("kv_value"),
        F.size("layout").alias("num_entries"), "confidence", "complete",
    )


def layout_trees(spark, sf):
    """Entries and pairs of nested payloads: a titled block, a list entry and a pair under 1 to 19 more brackets."""
    turn, text = F.col("turn"), F.col("text")
    number = lambda c: F.to_json(F.array(c))
    inner = F.concat(
        F.lit('{"role":'), F.regexp_replace(number(F.col("role")), r"^\[|\]$", ""), F.lit(',"blocks":[{"zone":[],"text":'),
        F.regexp_replace(number(text), r"^\[|\]$", ""), F.lit(',"score":'), ((turn % 4) * F.lit(0.25)).cast("string"), F.lit(',"bbox":[0,'), turn.cast("string"),
        F.lit('],"type":"block"},[[1,'), turn.cast("string"), F.lit('],"again",0.5],{"pair":{"field":"who","value":{"is":['), F.col("conv_id").cast("string"), F.lit("]}}}]}"),
    )
    depth = (turn % 7 * 3 + 1).cast("int")
    payload = F.when(turn % 11 != 10, F.concat(F.repeat(F.lit("["), depth), inner, F.repeat(F.lit("]"), depth))).otherwise(F.lit("{no json"))
    turns = render.spread(table(spark, sf, "conversations")).select("conv_id", "turn", payload.alias("payload"))
    done = layout.flatten_layout(turns).select("conv_id", "turn", "layout", F.col("text").alias("document_text"), F.to_json("kv").alias("pairs"), "confidence", "complete")
    return done.select("*", F.posexplode_outer("layout").alias("entry_no", "e")).select(
        "conv_id", "turn", "document_text", "pairs", "confidence", "complete", "entry_no",
        F.col("e.text").alias("text"), F.col("e.score").alias("score"), F.col("e.bbox").alias("bbox"), F.col("e.box").alias("box"), F.col("e.type").alias("type"),
    )


def _images(spark, sf) -> DataFrame:
    """Pages as images of their number and address; some are empty."""
    k = F.col("page_id")
    content = F.when(k % 10 != 4, F.concat_ws("|", k, "url")).otherwise(F.lit(""))
    return table(spark, sf, "pages").select(k.alias("doc_id"), render.choose(["passport", "china_id"], k).alias("plugin"), content.cast("binary").alias("content"))


def _reader():
    """An engine that reads numbered images, fails on some and returns nonsense for others."""

    def infer(content: bytes) -> dict:
        number, url = content.decode().split("|")
        if int(number) % 7 == 3:
            raise ValueError(f"unreadable {number}")
        if int(number) % 7 == 5:
            return {"lines": 7}
        return {"text": url, "lines": [{"text": number, "score": 0.25}, {"text": url}], "confidence": int(number) % 5 / 4}

    return infer


def _layout_reader():
    def infer(content: bytes):
        number, url = content.decode().split("|")
        if int(number) % 7 == 3:
            raise ValueError(f"unreadable {number}")
        return {"page": [{"text": url, "score": 0.5}, [None, f"no {number}", 1.0]]}

    return infer


def engine_results(spark, sf):
    results = process.recognise(_images(spark, sf), _reader, shared_dir(spark, "engine"), "r1", "reader")
    return results.select("doc_id", "plugin", "engine", "text", F.to_json("lines").alias("lines"), "confidence")


def engine_letters(spark, sf):
    """The stored letters of the images on which the engine failed."""
    out = shared_dir(spark, "engine")
    process.recognise(_images(spark, sf), _reader, out, "r1", "reader")
    return spark.read.schema("doc_id string, engine string, error string, run_id string, plugin string").json(f"{out}/recognition_letters")


def engine_layouts(spark, sf):
    """Layouts straight from an engine, beside its errors."""
    read = ocr.run_layout_engine(_images(spark, sf), _layout_reader, "layout")
    return layout.flatten_layout(read).select("doc_id", "text", F.size("layout").alias("num_entries"), "confidence", "complete", "error")


def _raw_results(spark, sf) -> str:
    """Result lines as JSON, one in ten cut short, one with text for a number, one without a document; three files."""
    k = F.col("o_orderkey")
    name = F.when(k % 10 != 8, F.concat(F.lit("o"), k))
    whole = F.to_json(F.struct(name.alias("doc_id"), F.lit("plain").alias("plugin"), F.col("o_orderpriority").alias("text"), ((k % 5) / F.lit(4.0)).alias("confidence")))
    text = F.when(k % 10 == 3, F.substr(whole, F.lit(1), F.length(whole) - 8)).when(k % 10 == 6, F.concat(F.lit('{"doc_id":"o'), k, F.lit('","confidence":"high"}'))).otherwise(whole)
    path = f"{shared_dir(spark, 'raw-results')}/lines"
    table(spark, sf, "orders").select(text.alias("value")).repartition(3, "value").write.text(path)
    return path


def wellformed_results(spark, sf):
    read = ocr.read_results(spark, _raw_results(spark, sf), "json", multi_line=False, keep_malformed=True)
    return ocr.split_malformed(read)[0].select("doc_id", "plugin", "text", "confidence")


def malformed_results(spark, sf):
    read = ocr.read_results(spark, _raw_results(spark, sf), "json", multi_line=False, keep_malformed=True)
    return ocr.split_malformed(read)[1]


def _manifest(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.lit("doc-"), k.cast("string"))
    path = F.when(k % 10 != 3, F.concat(F.lit("docs/"), k.cast("string"), F.lit(".png")))
    sample = F.array(
        F.struct(name.alias("sample_id"), F.col("lang").alias("doc_type"), path.alias("image_path"), F.array("source").alias("tags"))
    )
    text = F.when(k % 2 == 0, F.to_json(sample)).otherwise(F.to_json(F.struct(sample.alias("samples"))))
    return datasets.manifest_samples(table(spark, sf, "documents").select(text.alias("value")))


def manifest_samples(spark, sf):
    good, _ = datasets.build_manifest(_manifest(spark, sf), "set")
    return good.select("sample_id", "doc_type", "image_path", F.get("tags", 0).alias("tag"), "name", "version")


def manifest_errors(spark, sf):
    _, bad = datasets.build_manifest(_manifest(spark, sf), "set")
    return bad.select("sample_id", F.array_join("missing_keys", ",").alias("missing_keys"))


def _path(k: Column) -> Column:
    return F.concat(F.lit("docs/"), k.cast("string"), F.lit(".txt"))


def _assets(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("source").alias("category"), F.col("lang").alias("kind"),
        _path(F.col("doc_id")).alias("path"),
    )


def _files(spark, sf) -> DataFrame:
    """The labelled documents stand for the files that exist."""
    present = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return present.select(
        _path(F.col("doc_id")).alias("path"), F.octet_length("text").cast("bigint").alias("size_bytes"), F.encode("text", "UTF-8").alias("content")
    )


def asset_facts(spark, sf):
    return datasets.asset_facts(_assets(spark, sf), _files(spark, sf)).select(
        "sample_id", F.col("found_bytes").alias("size_bytes"), F.col("found_sha256").alias("sha256"), "error"
    )


def missing_assets(spark, sf):
    return datasets.missing_assets(_assets(spark, sf), _files(spark, sf))


def _asset_results(spark, sf):
    facts = datasets.asset_facts(_assets(spark, sf), _files(spark, sf))
    recognised = render.text_results(spark, sf).withColumnRenamed("doc_id", "sample_id")
    return profile.asset_results(facts, recognised)


def asset_summary(spark, sf):
    return profile.summary(_asset_results(spark, sf)[0])


def asset_totals(spark, sf):
    return profile.totals(*_asset_results(spark, sf))


def golden_rows(spark, sf):
    text = F.to_json(
        F.struct(
            F.col("c_name").alias("name"), F.lit(None).cast("string").alias("none"),
            F.array(F.lit("a"), F.col("c_mktsegment")).alias("tags"),
        ),
        {"ignoreNullFields": "false"},
    )
    golden = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), datasets.expected_map(text).alias("expected"))
    return datasets.expected_fields(golden)


def label_studio_rows(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    done = datasets.label_studio_rows(turns)
    field = lambda name, kind: F.try_variant_get("raw", f"$.{name}", kind)
    return done.select(
        "source", field("conv_id", "bigint").alias("conv_id"), field("turn", "bigint").alias("turn"), field("role", "string").alias("raw_role")
    )


def intake_verdicts(spark, sf):
    k = F.col("page_id")
    uploads = table(spark, sf, "pages").select(
        "page_id",
        F.get(F.array(F.lit("china_id"), F.lit("passport"), F.lit("driver_licence"), F.lit(None)), (k % 4).cast("int")).alias("plugin"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("html")).cast("binary").alias("content"),
    )
    return datasets.intake_verdicts(uploads, families.names()).select("page_id", "status", "reason")


def annotation_fields(spark, sf):
    notes = annotating.annotate(render.text_results(spark, sf))
    return unfold(notes, "fields", "sample_id").select(
        "sample_id", "item.field_name", "item.region_id", "item.value", F.round("item.confidence", 9).alias("confidence")
    )


def date_texts(spark, sf):
    """Dates in seven spellings; the last one runs into a word and is no date."""
    k = F.col("o_orderkey")
    spelt = lambda pattern: F.date_format("o_orderdate", pattern)
    text = F.get(
        F.array(
            spelt("yyyy-MM-dd"), F.concat(F.lit("on "), spelt("yyyy/M/d"), F.lit(".")), spelt("yyyy.M.d"), spelt("yyyy年M月d日"),
            F.concat(F.lit("日期 "), spelt("yyyy年MM月dd日"), F.lit(" 星期")), F.concat(spelt("yyyy-M-d"), F.lit(" or 2001-01-01")),
            F.concat(spelt("yyyy年M月d日"), F.lit("生")),
        ),
        (k % 7).cast("int"),
    )
    return table(spark, sf, "orders").select(k.alias("doc_id"), iso_date(text).alias("iso"))


def file_stems(spark, sf):
    k = F.col("page_id")
    path = F.when(k % 9 != 8, F.concat(F.lit("/data/in/scan."), k.cast("string"), F.lit(".jpg")))
    return table(spark, sf, "pages").select("page_id", file_stem(path).alias("sample_id"))


# --- families --------------------------------------------------------------------------------


def _fields(docs: DataFrame, name: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    done = families.extract(docs, families.get(name))
    return done.select("doc_id", *keep, *[F.col("fields")[c].alias(c) for c in columns])


def _judged(docs: DataFrame, name: str, overrides: DataFrame | None = None) -> DataFrame:
    return process.family_job(docs, name, overrides, render.AS_OF)


def _issues(docs: DataFrame, name: str, overrides: DataFrame | None = None) -> DataFrame:
    return process.issue_rows(_judged(docs, name, overrides)).select("doc_id", "seq", "code", "severity", "field")


def id_card_fields(spark, sf):
    return _fields(
        render.id_cards(spark, sf), "china_id",
        "document_side", "name", "gender", "ethnicity", "birth_date", "address", "id_number",
    )


def id_back_fields(spark, sf):
    return _fields(render.id_backs(spark, sf), "china_id", "document_side", "issuing_authority", "valid_from", "valid_to")


def id_number_issues(spark, sf):
    return _issues(render.id_cards(spark, sf), "china_id")


def id_decisions(spark, sf):
    bad_sum = F.exists("issues", lambda i: i["code"] == "checksum_invalid")
    return _judged(render.id_cards(spark, sf), "china_id").groupBy("segment").agg(
        F.count(F.lit(1)).alias("num_documents"), F.count(F.when(F.col("accepted"), 1)).alias("num_accepted"),
        F.count(F.when(bad_sum, 1)).alias("num_bad_checksums"),
    )


def passport_fields(spark, sf):
    return _fields(render.passports(spark, sf), "passport", *passport.MRZ_FIELDS)


def passport_issues(spark, sf):
    return _issues(render.passports(spark, sf), "passport", render.passport_overrides(spark, sf))


BOOKLET_FIELDS = list(rules.BOOKLET_ALIASES)


def booklet_fields(spark, sf):
    return _fields(render.booklets(spark, sf), "hukou_booklet", *BOOKLET_FIELDS)


def booklet_issues(spark, sf):
    return _issues(render.booklets(spark, sf), "hukou_booklet")


def booklet_scores(spark, sf):
    return _judged(render.booklets(spark, sf), "hukou_booklet").groupBy("score", "accepted").agg(
        F.count(F.lit(1)).alias("num_documents")
    )


def record_fields(spark, sf):
    done = families.extract(render.records(spark, sf), families.get("medical_record"))
    plain = ["hospital_name", "patient_name", "gender", "age", "visit_date", "department", "notes"]
    return done.select(
        "doc_id", *[F.col("fields")[c].alias(c) for c in plain],
        *[F.array_join(F.col("fields")[c], "|").alias(c) for c in ("diagnosis", "medications")],
    )


def record_items(spark, sf):
    done = families.extract(render.records(spark, sf), families.get("medical_record"))
    kinds = F.array(
        F.struct(F.lit("diagnosis").alias("kind"), F.col("fields.diagnosis").alias("items")),
        F.struct(F.lit("medication").alias("kind"), F.col("fields.medications").alias("items")),
    )
    return done.select("doc_id", F.explode(kinds).alias("k")).select(
        "doc_id", F.col("k.kind").alias("kind"), F.explode("k.items").alias("item")
    )


def record_issues(spark, sf):
    return _issues(render.records(spark, sf), "medical_record")


def boarding_fields(spark, sf):
    return _fields(
        render.boarding_passes(spark, sf), "boarding_pass", "passenger_name", "flight_number", "ticket_number",
        "departure_date", "departure_airport", "arrival_airport", "gate",
    )


def boarding_issues(spark, sf):
    return _issues(render.boarding_passes(spark, sf), "boarding_pass")


def train_fields(spark, sf):
    return _fields(
        render.train_tickets(spark, sf), "train_ticket", "document_variant", "ticket_number", "passenger_name",
        "train_number", "departure_station", "arrival_station", "departure_time", "gate",
    )


def train_issues(spark, sf):
    return _issues(render.train_tickets(spark, sf), "train_ticket")


# --- joins over lines and fields -------------------------------------------------------------


def label_values(spark, sf):
    docs = lines.with_rows(render.booklets(spark, sf))
    found = labels.labelled_values(F.col("rows"), rules.BOOKLET_ALIASES)
    return unfold(docs, found, "doc_id").select("doc_id", "item.field", "item.value")


def label_values_of_lines(spark, sf):
    table_of_lines = lines.explode_lines(render.booklets(spark, sf))
    pairs = ", ".join(f"('{a}', '{f}')" for a, f in labels.alias_pairs(rules.BOOKLET_ALIASES))
    aliases = spark.sql(f"SELECT * FROM VALUES {pairs} AS t(alias, field)")
    return labels.label_values_of_lines(table_of_lines, aliases).select("doc_id", "field", "value")


def place_routes(spark, sf):
    names = ", ".join(f"('{n}')" for n in rules.AIRPORTS)
    gazetteer = spark.sql(f"SELECT * FROM VALUES {names} AS t(token)")
    return places.place_route_of_lines(lines.explode_lines(render.boarding_passes(spark, sf)), gazetteer)


def nearest_candidates(spark, sf):
    x, y = F.col("l_quantity"), F.col("l_tax")
    candidates = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("text"),
        F.col("l_discount").alias("score"),
        F.struct(x.alias("x1"), y.alias("y1"), (x + 2).alias("x2"), (y + 1).alias("y2")).alias("bbox"),
    )
    ax = (F.col("o_orderkey") % 50).cast("double")
    anchors = table(spark, sf, "orders").where(F.col("o_orderkey") % 10 != 3).select(
        F.col("o_orderkey").alias("doc_id"),
        F.struct(ax.alias("x1"), F.lit(0.0).alias("y1"), (ax + 2).alias("x2"), F.lit(1.0).alias("y2")).alias("bbox"),
    )
    return places.nearest_candidate(candidates, anchors).withColumn("distance", F.round("distance", 9))


def merged_fields(spark, sf):
    pairs = F.array(
        F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")),
    )
    parsed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(pairs).alias("p")).select("doc_id", "p.*")
    k = F.col("c_custkey")
    provided = table(spark, sf, "customer").select(
        k.alias("doc_id"), F.when(k % 3 == 0, F.lit("status")).otherwise(F.lit("extra")).alias("field"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("value"),
    )
    return merging.merge_fields(parsed, provided)


# --- evaluation ------------------------------------------------------------------------------


def _compared(spark, sf) -> DataFrame:
    """Golden booklet fields against extracted ones; the golden number is always the right one."""
    k = F.col("doc_id")
    golden = render.numbered_customers(spark, sf).select(
        "doc_id",
        F.create_map(
            F.lit("member_name"), F.concat(F.lit("M"), k.cast("string")),
            F.lit("gender"), F.get(F.array(F.lit("女"), F.lit("男"), F.lit(None)), (F.floor(k / 3) % 3).cast("int")),
            F.lit("id_number"), F.col("right_idn"),
            F.lit("birth_date"), F.date_format(render.birth_day(k), "yyyy-MM-dd"),
            F.lit("spouse"), F.lit(None).cast("string"),
        ).alias("expected"),
    )
    booklets = process.process(render.booklets(spark, sf), as_of=render.AS_OF, only=["hukou_booklet"])
    predicted = review.with_decision(booklets).select("doc_id", "plugin", "field_values", "accepted", "decision")
    return evaluation.compare(golden, predicted)


def field_outcomes(spark, sf):
    return evaluation.field_rows(_compared(spark, sf)).select("doc_id", "field", "expected", "predicted", "matched")


def document_scores(spark, sf):
    return evaluation.document_scores(_compared(spark, sf)).select(
        "doc_id", "num_fields", "num_matched_fields", "field_exact_match_rate", "status"
    )


def evaluation_totals(spark, sf):
    done = evaluation.totals(evaluation.document_scores(_compared(spark, sf)))
    return done.withColumn("overall_field_exact_match_rate", F.round("overall_field_exact_match_rate", 9))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def evaluation_report(spark, sf):
    report = evaluation.evaluation_report(_compared(spark, sf), ~F.col("accepted"))
    return _rounded(report, "exact_match", "f1", "document_success_rate", "review_rate")


def quality_metrics(spark, sf):
    metrics = evaluation.quality_metrics(_compared(spark, sf)).drop("mrz_line_exact_match")
    return _rounded(metrics, *[c for c in metrics.columns if c not in ("plugin", "num_documents")])


# --- datasets --------------------------------------------------------------------------------


def dataset_summary(spark, sf):
    samples = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("doc_type"))
    return splitting.dataset_summary(samples).select("num_samples", F.array_join("doc_types", ",").alias("doc_types"))


def positional_split(spark, sf):
    return splitting.positional_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8)


def positional_split_events(spark, sf):
    split = splitting.positional_split(table(spark, sf, "events").select("ts"), "ts", 0.7)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("num_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def positional_split_ties(spark, sf):
    """Four languages order the documents, the id decides between equals; some rows have no language."""
    samples = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"))
    return splitting.positional_split(samples, "lang", 0.6, "doc_id").select("doc_id", "split")


def dataset_layers(spark, sf):
    samples = table(spark, sf, "labels")
    return splitting.layers(samples, "doc_id", F.col("doc_id") % 20 == 7, (F.col("quality") == 0) | (F.col("toxic") == 1)).select("doc_id", "layer")


def malformed_manifests(spark, sf):
    k = F.col("doc_id")
    text = F.get(F.array(F.concat(F.lit('{"samples": '), F.col("text")), F.lit('{"name": "n"}'), F.lit("[]"), F.to_json(F.array(F.struct(F.col("text").alias("sample_id"))))),
                 (k % 4).cast("int"))
    return datasets.malformed_manifests(table(spark, sf, "documents").select(k, text.alias("value"))).select("doc_id", "error")


def label_values_of_foreign_lines(spark, sf):
    """The same over a line table that does not know its next lines."""
    pairs = ", ".join(f"('{a}', '{f}')" for a, f in labels.alias_pairs(rules.BOOKLET_ALIASES))
    aliases = spark.sql(f"SELECT * FROM VALUES {pairs} AS t(alias, field)")
    plain = lines.explode_lines(render.booklets(spark, sf)).drop("next_text")
    return labels.label_values_of_lines(plain, aliases).select("doc_id", "field", "value")


def unrecognised_assets(spark, sf):
    """Every fifth recognition result is missing; paths are spelt in three ways."""
    assets, k = _assets(spark, sf), F.col("sample_id")
    spelt = F.when(k % 3 == 0, F.concat(F.lit("file:///data/"), F.col("path"))).when(k % 3 == 1, F.concat(F.lit("./"), F.col("path"))).otherwise(F.col("path"))
    files = _files(spark, sf).withColumn("path", F.concat(F.lit("file:/data/"), F.col("path")))
    facts = datasets.asset_facts(assets.withColumn("path", spelt), files, "/data")
    recognised = render.text_results(spark, sf).withColumnRenamed("doc_id", "sample_id").where(k % 5 != 0)
    return profile.asset_results(facts, recognised)[1].select("sample_id", "error")


def kept_overrides(spark, sf):
    """Provided fields that the family does not know stay in the result; so does what was read before."""
    given = render.passport_overrides(spark, sf)
    extra = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"))
    nameless = extra.withColumn("field", F.lit(None).cast("string"))
    done = process.process(render.passports(spark, sf), given.select("doc_id", "field", "value").unionByName(extra).unionByName(nameless), render.AS_OF, only=["passport"])
    return done.select("doc_id", F.try_element_at("field_values", F.lit("segment")).alias("segment"), F.map_contains_key("parsed_fields", F.lit("segment")).alias("was_read"))


def hash_split(spark, sf):
    return splitting.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.8)


def hard_share(spark, sf):
    split = splitting.positional_split(table(spark, sf, "labels"), "doc_id", 0.8)
    return splitting.hard_share(split, (F.col("quality") == 0) | (F.col("toxic") == 1))


# --- the document job ------------------------------------------------------------------------


def mixed_results(spark, sf) -> DataFrame:
    """All families in one table, with a few documents that belong to none."""
    parts = [
        render.id_cards(spark, sf), render.passports(spark, sf), render.booklets(spark, sf), render.records(spark, sf),
        render.boarding_passes(spark, sf), render.train_tickets(spark, sf), render.text_results(spark, sf),
    ]
    named = [
        p.select(F.concat("plugin", F.lit("/"), F.col("doc_id").cast("string")).alias("doc_id"), "plugin", "lines") for p in parts
    ]
    return reduce(DataFrame.unionByName, named)


def _decided(spark, sf) -> DataFrame:
    return review.with_decision(process.process(mixed_results(spark, sf), as_of=render.AS_OF))


def rejected_unrouted(spark, sf):
    """The job's rows of documents that belong to no family, as dead letters with their text."""
    done = process.process(mixed_results(spark, sf), as_of=render.AS_OF, keep_unrouted=True)
    letters = process.dead_letters(done).where("plugin = 'plain'")
    return letters.select("doc_id", F.get("issues", 0)["code"].alias("reason"), F.get("issues", 0)["message"].alias("message"), F.size("lines").alias("num_lines"))


def processed_documents(spark, sf):
    return _decided(spark, sf).select(
        "doc_id", "plugin", "accepted", "score", F.size("issues").alias("num_issues"), "decision"
    )


def unroutable_documents(spark, sf):
    return process.unroutable(mixed_results(spark, sf)).groupBy("plugin").agg(F.count(F.lit(1)).alias("num_documents"))


def dead_letters(spark, sf):
    return process.dead_letters(_decided(spark, sf)).select(
        "doc_id", "plugin", "sample_id", F.size("issues").alias("num_issues"), "score"
    )


def failures_by_cause(spark, sf):
    return review.failures_by_cause(process.issue_rows(_decided(spark, sf)))


def top_failures(spark, sf):
    issues = process.issue_rows(_decided(spark, sf))
    week = F.concat(F.lit("week "), (F.split_part("doc_id", F.lit("/"), F.lit(2)).cast("bigint") % 4).cast("string"))
    return review.top_failures(issues, 5, week).select("period", "plugin", "code", "num_issues", "rank")


def decisions(spark, sf):
    return _decided(spark, sf).groupBy("plugin", "decision").agg(F.count(F.lit(1)).alias("num_documents"))


def review_queue(spark, sf):
    done = process.process(
        render.passports(spark, sf), render.passport_overrides(spark, sf), render.AS_OF, only=["passport"]
    )
    return review.review_queue(review.with_decision(done)).select(
        "doc_id", F.size("evidence").alias("num_fields"), F.size("errors").alias("num_errors")
    )


def _numbered(spark, sf) -> DataFrame:
    """Identity cards with a label line, weaker in score, and the right number again on a stronger line."""
    k = F.col("doc_id")
    docs = render.numbered_customers(spark, sf).select(
        "doc_id",
        render.lines(
            F.when(k % 17 != 9, render.line(F.concat(F.lit("身份证号: "), F.lower("idn")), 0.5)),
            render.line(F.concat(F.lit("no "), F.col("right_idn")), 0.9),
        ).alias("lines"),
    )
    return review.choose_candidate(review.number_candidates(lines.with_rows(docs), as_of()))


def number_candidates(spark, sf):
    return unfold(_numbered(spark, sf), "candidates", "doc_id").select(
        "doc_id", "item.value", "item.labelled", F.round("item.score", 9).alias("score")
    )


def chosen_numbers(spark, sf):
    return _numbered(spark, sf).select("doc_id", "chosen")


def completeness(spark, sf):
    kinds = list(rules.EXPECTED_FIELDS)
    done = review.completeness(process.process(mixed_results(spark, sf), as_of=render.AS_OF, only=kinds))
    return done.withColumn("missing_rate", F.round("missing_rate", 9))


def quality_routes(spark, sf):
    defects = F.create_map(
        F.lit("blur"), F.col("l_discount") * 10, F.lit("glare"), F.col("l_tax") * 10, F.lit("shadow"), F.col("l_quantity") / 50
    )
    scores = table(spark, sf, "lineitem").select(
        render.choose(["boarding_pass", "hukou_booklet", "passport"], F.col("l_linenumber")).alias("plugin"), defects.alias("quality")
    )
    return review.quality_route(scores).groupBy("plugin", "route", "passed").agg(
        F.count(F.lit(1)).alias("num_images"), F.sum(F.size("reasons")).alias("num_reasons")
    )


def card_pairs(spark, sf):
    front = families.extract(render.id_cards(spark, sf), families.get("china_id"))
    back = families.extract(render.id_backs(spark, sf), families.get("china_id"))
    cards = front.select((F.col("doc_id") % 400).alias("case_id"), "doc_id", "fields").unionByName(
        back.select((F.col("doc_id") * 5).alias("case_id"), "doc_id", "fields")
    )
    return merging.pair_sides(cards).select(
        "case_id", F.col("front.doc_id").alias("front_id"), F.col("back.doc_id").alias("back_id"), "num_fronts", "num_backs",
        F.array_join("warnings", "|").alias("warnings"),
    )


def source_selection(spark, sf):
    k = F.col("o_orderkey")
    results = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("field"), k.cast("string").alias("value"),
        ((k % 1000) / 1000.0).alias("confidence"), render.choose(rules.SOURCE_PRIORITY, k).alias("source"),
    )
    return _rounded(merging.select_by_source(results), "confidence", "mean_confidence")


def _order_notes(spark, sf) -> DataFrame:
    """One annotation per order with a label region, a value region and the relation between them."""
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("order").alias("plugin"),
        render.lines(render.line(F.col("o_orderpriority")), render.line(F.col("o_orderstatus"))).alias("lines"),
    )
    link = F.array(F.struct(F.lit("r1").alias("from_id"), F.lit("r2").alias("to_id"), F.lit("label_of").alias("relation_type")))
    return annotating.annotate(docs, F.col("doc_id")).withColumn("relations", link)


def tagged_annotations(spark, sf):
    tags = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("tag"), F.col("l_discount").alias("score"),
        F.lit(None).cast("string").alias("note"),
    )
    return merging.tag_rows(merging.attach_tags(_order_notes(spark, sf), tags)).select("sample_id", "tag", "score")


def relation_texts(spark, sf):
    return merging.relation_rows(_order_notes(spark, sf))


def unknown_sources(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("role").alias("source"))
    return merging.unknown_values(turns, "source", rules.FIELD_SOURCES).groupBy("source").agg(F.count(F.lit(1)).alias("num_rows"))


# --- streams ---------------------------------------------------------------------------------


def _event_decisions(events: DataFrame) -> DataFrame:
    value = F.col("value")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("plugin"), (value >= 10).alias("accepted"),
        F.when(value >= 10, F.lit("accept")).when(value >= 5, F.lit("review")).otherwise(F.lit("reject")).alias("decision"),
    )


def decision_rates(spark, sf):
    rates = live.decision_rates(_event_decisions(table(spark, sf, "events")), "ts")
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def first_uploads(spark, sf):
    uploads = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), "ts", "event_id")
    return live.first_uploads(uploads, "ts")


def _stream_source(spark, sf, name: str) -> DataFrame:
    """One driver table as a stream of its file."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _finished(spark, df: DataFrame, purpose: str) -> DataFrame:
    base = shared_dir(spark, purpose)
    live.write_stream(df, f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _stored_results(spark, sf) -> str:
    """Mixed results written where a stream can pick them up."""
    path = f"{shared_dir(spark, 'intake')}/results"
    process.with_contract(mixed_results(spark, sf)).select(
        "doc_id", "plugin", "engine", "text", "lines", "confidence"
    ).write.parquet(path)
    return path


def live_decisions(spark, sf):
    stream = live.read_results_stream(spark, _stored_results(spark, sf), "parquet")
    done = live.process_stream(stream, as_of=render.AS_OF).select(
        "doc_id", "plugin", "accepted", "score", F.size("issues").alias("num_issues")
    )
    return _finished(spark, done, "live-decisions")


def live_dead_letters(spark, sf):
    intake, base = _stored_results(spark, sf), shared_dir(spark, "live-letters")
    stream = live.read_results_stream(spark, intake, "parquet")
    live.dead_letter_stream(live.process_stream(stream, as_of=render.AS_OF), f"{base}/out", f"{base}/state", once=True).awaitTermination()
    remove_dir(spark, intake)  # the letters hold all that is read from here on
    stored = spark.read.schema(
        "doc_id string, issues array<struct<code:string>>, run_id string, plugin string"
    ).json(f"{base}/out")
    return stored.select("doc_id", "plugin", F.size("issues").alias("num_issues"))


def live_rates(spark, sf):
    """Closed windows only: the last ones wait for later events."""
    decided = _event_decisions(_stream_source(spark, sf, "events"))
    done = _finished(spark, live.decision_rates(decided, "ts"), "live-rates")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def live_uploads(spark, sf):
    """Repeats within an hour are dropped; which one is kept depends on arrival."""
    uploads = _stream_source(spark, sf, "events").select(
        F.col("user_id").alias("sample_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    return _finished(spark, live.drop_repeats(uploads, "ts"), "live-uploads").select("sample_id")


def live_malformed(spark, sf):
    """Letters of a stream of result lines, over several micro-batches."""
    stream = live.read_results_stream(spark, _raw_results(spark, sf), "json", files_per_trigger=1, multi_line=False, keep_malformed=True)
    return _finished(spark, ocr.split_malformed(stream)[1], "live-malformed")


def _parts(spark, rows: DataFrame, purpose: str, files: int) -> str:
    """Rows in so many files, dealt without regard to their order."""
    path = f"{shared_dir(spark, purpose)}/rows"
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(path)
    return path


def live_intake(spark, sf):
    """Uploads judged as they arrive, from both sinks."""
    k, known = F.col("page_id"), families.names()
    uploads = table(spark, sf, "pages").select(
        "page_id", F.get(F.array(F.lit("china_id"), F.lit("passport"), F.lit("driver_licence"), F.lit(None)), (k % 4).cast("int")).alias("plugin"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("html")).cast("binary").alias("content"),
    )
    path, base = _parts(spark, uploads, "uploads", 4), shared_dir(spark, "live-intake")
    stream = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.intake_stream(stream, known, f"{base}/accepted", f"{base}/rejected", f"{base}/state", once=True).awaitTermination()
    note = "content struct<type:string,size:int>"
    good = spark.read.schema(uploads.schema).option("recursiveFileLookup", True).parquet(f"{base}/accepted")
    bad = spark.read.schema(f"page_id long, plugin string, {note}, status int, reason string").option("recursiveFileLookup", True).parquet(f"{base}/rejected")
    good = good.select("page_id", "plugin", F.lit(200).alias("status"), F.lit(None).cast("string").alias("reason"), F.octet_length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return good.unionByName(bad.select("page_id", "plugin", "status", "reason", F.col("content.size").alias("size_bytes"), F.lit(None).cast("string").alias("sha256")))


def live_latest_uploads(spark, sf):
    """Uploads replace earlier ones of their user; many arrive late."""
    uploads = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"), "ts", "event_id", "event_type", "value")
    path, base = _parts(spark, uploads, "events", 6), shared_dir(spark, "live-latest")
    stream = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 2).parquet(path)
    live.latest_upload_stream(stream, "ts", f"{base}/versions", f"{base}/state", once=True).awaitTermination()
    return live.read_latest(spark, f"{base}/versions", uploads.schema, "ts")


def working_set(spark, sf):
    """Half of the labelled documents, with a fifth of hard ones at least."""
    labelled = table(spark, sf, "labels")
    hard = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return splitting.working_set(labelled, "doc_id", hard, labelled.count() // 2, 0.2).select("doc_id", hard.alias("hard"))


def _sheet_candidates(spark, sf) -> DataFrame:
    found = spark.createDataFrame([("itinerary", *r) for r in render.ITINERARY_RULES], candidates.RULE_SCHEMA)
    return candidates.candidates(lines.with_rows(render.itineraries(spark, sf)), found, as_of())


def field_candidates(spark, sf):
    return candidates.ranked(_sheet_candidates(spark, sf)).select(
        "doc_id", "field", "value", F.round("score", 9).alias("score"), "anchored", "valid", "line_no", "rank")


def chosen_fields(spark, sf):
    return candidates.chosen(_sheet_candidates(spark, sf)).select("doc_id", "field", "value", F.round("score", 9).alias("score"), F.round("lead", 9).alias("lead"))


def review_candidates(spark, sf):
    """The queue of a kind nobody can read yet, with its candidates beside each document."""
    sheets = process.process(render.itineraries(spark, sf), as_of=render.AS_OF, keep_unrouted=True)
    queue = review.review_queue(sheets.withColumn("decision", F.lit("review")))
    shown = review.with_candidates(queue, candidates.ranked(_sheet_candidates(spark, sf), 1))
    return shown.select(
        "doc_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws("=", c["field"], c["value"])), "; ").alias("best"),
        F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("errors"), F.array_join(F.transform("lines", lambda r: r["text"]), "|").alias("lines"))


def review_evidence(spark, sf):
    """Queued passports: each value with the lines it stands in."""
    done = process.process(render.passports(spark, sf), render.passport_overrides(spark, sf), render.AS_OF, only=["passport"])
    queue = unfold(review.review_queue(review.with_decision(done)), "evidence", "doc_id").select("doc_id", "item.*")
    return queue.where(F.col("field").isin("passport_number", "surname", "personal_number")).select(
        "doc_id", "field", "value", F.transform("candidates", lambda c: c["line_no"]).alias("line_nos"))


#: Kinds by version: a kind read by another family's reader, one whose last version is withdrawn, one with no reader.
KINDS = [
    ("passport", 1, True, None, ["passport_number", "surname", "expiry_date"], [("blur", 0.3, 0.6)]),
    ("visa_page", 1, False, "booklet", ["never"], []),
    ("visa_page", 2, True, "passport", ["passport_number", "personal_number", "seal"], [("blur", 0.5, 0.9), ("glare", 0.2, 0.4)]),
    ("old_card", 1, True, "passport", ["surname"], [("blur", 0.5, 0.8)]),
    ("old_card", 2, False, "passport", ["surname"], [("blur", 0.5, 0.8)]),
    ("ghost", 1, True, "nobody", ["surname"], []),
]


def _kinds(spark) -> DataFrame:
    return spark.createDataFrame(KINDS, registry.KIND_SCHEMA)


def _of_kinds(spark, sf) -> DataFrame:
    docs = render.passports(spark, sf).withColumn("plugin", render.choose(["passport", "visa_page", "old_card", "ghost", "stranger"], F.col("doc_id")))
    return registry.process_kinds(docs, _kinds(spark), as_of=render.AS_OF)


def kind_documents(spark, sf):
    return _of_kinds(spark, sf).select("doc_id", "kind", "kind_version", "plugin", "accepted", F.get("issues", 0)["code"].alias("first_issue"))


def kind_completeness(spark, sf):
    return registry.completeness(_of_kinds(spark, sf), _kinds(spark)).withColumn("missing_rate", F.round("missing_rate", 9))


def kind_quality(spark, sf):
    defects = F.create_map(F.lit("blur"), F.col("l_discount") * 10, F.lit("glare"), F.col("l_tax") * 10)
    scores = table(spark, sf, "lineitem").select(render.choose(["passport", "visa_page", "old_card", "ghost"], F.col("l_linenumber")).alias("plugin"), defects.alias("quality"))
    return registry.quality_route(scores, _kinds(spark)).groupBy("plugin", "route", "passed", F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("num_images"))


def _two_families(spark, sf) -> DataFrame:
    """Golden passports with their right zone, and golden booklets, against one run of the job over both."""
    k = F.col("doc_id")
    right = F.col("right_lines")
    zone = render.passports(spark, sf).select("doc_id", F.transform("lines", lambda l: l["text"]).alias("right_lines"))
    pair = F.filter(right, lambda t: F.length(t) >= 44)
    second = F.element_at(right, -1)
    number = F.concat(F.lit("C"), render.digits(k % 10000000, 7))
    passports = zone.select(
        F.concat(F.lit("p/"), k.cast("string")).alias("doc_id"),
        F.create_map(
            F.lit("passport_number"), number, F.lit("surname"), F.lit("CUSTOMER"),
            F.lit("mrz_lines"), F.when((k % 9 != 4) & ~(k % 6).isin(1, 2), F.to_json(F.array(F.upper(F.translate(F.translate(F.element_at(pair, -2), "«", "<"), " ", "")), second)))
            .otherwise(F.lit("[]")).cast("string"),
        ).alias("expected"),
    )
    booklets = render.numbered_customers(spark, sf).select(
        F.concat(F.lit("b/"), k.cast("string")).alias("doc_id"),
        F.create_map(F.lit("member_name"), F.concat(F.lit("M"), k.cast("string")), F.lit("birth_date"), F.date_format(render.birth_day(k), "yyyy-MM-dd")).alias("expected"))
    named = lambda docs, prefix: docs.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("doc_id"), "plugin", "lines")
    both = named(render.passports(spark, sf), "p/").unionByName(named(render.booklets(spark, sf), "b/"))
    done = review.with_decision(process.process(both, as_of=render.AS_OF)).select("doc_id", "plugin", "field_values", "accepted", "decision")
    return evaluation.compare(passports.unionByName(booklets), done)


def family_metrics(spark, sf):
    metrics = evaluation.quality_metrics(_two_families(spark, sf))
    return _rounded(metrics, *[c for c in metrics.columns if c not in ("plugin", "num_documents")])


def family_report(spark, sf):
    return _rounded(evaluation.evaluation_report(_two_families(spark, sf), ~F.col("accepted")), "exact_match", "f1", "document_success_rate", "review_rate")


def stored_report(spark, sf):
    """The report as written: its header and how many result lines stand beside it."""
    scored, path = evaluation.document_scores(_compared(spark, sf)), shared_dir(spark, "report")
    evaluation.write_report("booklets", evaluation.totals(scored), scored, path, F.lit("2026-01-01").cast("timestamp"), ocr_backend="rendered")
    head = spark.read.schema("schema_version string, report_name string, generated_at string, runner struct<ocr_backend:string>, totals struct<num_fixtures:long,num_passed:long,num_matched_fields:long,status:string>").json(f"{path}/header")
    results = spark.read.schema("doc_id long, status string, num_matched_fields int").json(f"{path}/results")
    stored = results.agg(F.count(F.lit(1)).alias("num_results"), F.count(F.when(F.col("status") == "pass", 1)).alias("num_passed_results"), F.sum("num_matched_fields").alias("num_matched_results"))
    return head.select("schema_version", "report_name", "generated_at", "runner.ocr_backend", "totals.*").join(stored.withColumn("report_name", F.lit("booklets")), "report_name")


CODES = ["missing_mrz_lines", "missing_name", "length_invalid", "checksum_invalid", "invalid_gender", "birth_date_mismatch", "region_code_invalid", "blur_high", "cropped_edge",
         "layout_overlap", "same_departure_arrival", "house_rule", "odd_code"]


def cause_classes(spark, sf):
    """Issues of every class, two of them named by a table of causes, one by nobody."""
    issues = table(spark, sf, "lineitem").select(render.choose(["passport", "train_ticket"], F.col("l_linenumber")).alias("plugin"), render.choose(CODES, F.col("l_partkey")).alias("code"))
    causes = spark.createDataFrame([("house_rule", "policy_error", None), ("cropped_edge", "scanner_error", "train_ticket")], "code string, root_cause string, plugin string")
    return review.failures_by_cause(issues, causes)


def vocabulary_checks(spark, sf):
    """Values of closed vocabularies, the good rows and the broken ones by what is wrong with them."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        render.choose([*rules.FIELD_SOURCES, "guess"], k).alias("source"), F.get(F.array(*[F.lit(v) for v in rules.SEVERITIES], F.lit(None)), (k % 4).cast("int")).alias("severity"),
        F.get(F.array(*[F.lit(v) for v in [*rules.ANGLES, 45]]), (k % 5).cast("int")).alias("angle"))
    checked = merging.vocabulary_violations(rows, {"source": rules.FIELD_SOURCES, "severity": rules.SEVERITIES, "angle": rules.ANGLES})
    return checked.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("num_rows"))


def train_variants(spark, sf):
    """Train tickets that turn out to be boarding passes: the airline's marks change what the number and the places are."""
    k = F.col("doc_id")
    marked = render.train_tickets(spark, sf).withColumn(
        "lines", F.when(k % 4 == 1, F.concat(F.array(render.line("flight", 0.9), render.line(F.concat(F.lit("CA "), (1000 + k % 9000).cast("string")), 0.9)), F.col("lines")))
        .when(k % 4 == 2, F.concat(F.array(render.line("登机牌 CZ3099", 0.9)), F.col("lines"))).otherwise(F.col("lines")))
    return _fields(marked, "train_ticket", "document_variant", "train_number", "departure_station")


def id_side_issues(spark, sf):
    """Both sides of cards under the rules that judge a back side by its authority and dates."""
    cards = families.Family("china_id", rules=china_id.china_id_side_rules, reading=china_id.china_id_reading)
    back = render.id_backs(spark, sf).withColumn("lines", F.when(F.col("doc_id") % 7 == 3, F.slice("lines", 1, 2)).otherwise(F.col("lines")))
    front = render.id_cards(spark, sf).select((-F.col("doc_id")).alias("doc_id"), "plugin", "lines")
    judged = families.validate(families.extract(front.unionByName(back), cards), cards, render.AS_OF)
    return process.issue_rows(judged).select("doc_id", "seq", "code", "severity", "field")


def plain_family(spark, sf):
    """Documents of a family with neither parser nor rules: registered, read as nothing, accepted."""
    families.register(families.Family("plain"))
    try:
        done = process.process(render.text_results(spark, sf), as_of=render.AS_OF, only=["plain"])
        return done.select("doc_id", "plugin", F.to_json("field_values").alias("field_values"), "accepted", "score", F.size("issues").alias("num_issues"))
    finally:
        families.unregister("plain")


def family_registry(spark, sf):
    """What is registered, beside how many mixed documents each family has."""
    counts = mixed_results(spark, sf).groupBy("plugin").agg(F.count(F.lit(1)).alias("num_documents"))
    return families.registered(spark).join(counts, F.col("name") == F.col("plugin"), "left").select("name", "version", "description", F.array_join("tags", ",").alias("tags"), "num_documents")


QUERIES = [
    ocr_lines, line_profile, payload_lines, payload_documents, layout_fields, manifest_samples, manifest_errors, asset_facts,
    missing_assets, asset_summary, asset_totals, golden_rows, label_studio_rows, intake_verdicts, annotation_fields, date_texts,
    file_stems, id_card_fields, id_back_fields, id_number_issues, id_decisions, passport_fields, passport_issues, booklet_fields,
    booklet_issues, booklet_scores, record_fields, record_items, record_issues, boarding_fields, boarding_issues, train_fields,
    train_issues, label_values, label_values_of_lines, place_routes, nearest_candidates, merged_fields, field_outcomes,
    document_scores, evaluation_totals, evaluation_report, quality_metrics, dataset_summary, positional_split,
    positional_split_events, positional_split_ties, hash_split, dataset_layers, malformed_manifests, label_values_of_foreign_lines,
    unrecognised_assets, kept_overrides, rejected_unrouted, hard_share, processed_documents, unroutable_documents, dead_letters, failures_by_cause,
    top_failures, decisions, review_queue, number_candidates, chosen_numbers, completeness, quality_routes, card_pairs,
    source_selection, tagged_annotations, relation_texts, unknown_sources, decision_rates, first_uploads, live_decisions,
    live_dead_letters, live_rates, live_uploads, layout_trees, engine_results, engine_letters, engine_layouts, wellformed_results,
    malformed_results, live_malformed, live_intake, live_latest_uploads, working_set, field_candidates, chosen_fields,
    review_candidates, review_evidence, kind_documents, kind_completeness, kind_quality, family_metrics, family_report, stored_report,
    cause_classes, vocabulary_checks, train_variants, id_side_issues, plain_family, family_registry,
]


def queries():
    return {f.__name__: f for f in QUERIES}
