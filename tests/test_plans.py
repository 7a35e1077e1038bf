import hashlib
import random

import pytest
from pyspark.sql import functions as F

from formgrain import families
from formgrain.operators import candidates, lines, merging, splitting
from formgrain.plans import process, registry, review

from .goldens import GOLDENS, box

AS_OF = "2026-01-01"


def key_hash(key):
    return int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("counted", [8, 100_000])
def test_keys_are_found_whatever_is_counted_at_once(spark, monkeypatch, counted):
    """Brackets are refined again and again when few keys may be counted; texts share long beginnings."""
    monkeypatch.setattr(splitting, "COUNTED", counted)
    rng = random.Random(4)
    texts = ["shared beginning of all keys " + "".join(rng.choice("ab\0é漢") for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "z", "shared"]
    columns = {"k string": texts, "k double": [rng.choice([-1.5, 0.0, 2.25, rng.random()]) for _ in range(200)], "k boolean": [rng.random() < 0.3 for _ in range(50)], "k long": [7] * 40 + [8]}
    for schema, values in columns.items():
        df = spark.createDataFrame([(v,) for v in values], schema).repartition(3)
        order = sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)
        for position in {0, len(values) // 3, len(values) // 2, len(values) - 1}:
            value, among, equals = splitting.key_at(df, position)
            assert (value, order.index(value) + among, equals) == (order[position], position, values.count(value))


@pytest.mark.parametrize("hard,easy,size", [(50, 400, 100), (5, 400, 100), (300, 20, 100), (0, 50, 20), (40, 0, 20), (10, 10, 100), (0, 0, 5), (7, 93, 0)])
def test_working_set_holds_its_share(spark, hard, easy, size):
    rows = [(i, i < hard) for i in range(hard)] + [(1000 + i, None if i % 2 else False) for i in range(easy)]
    df = spark.createDataFrame(rows, "id int, hard boolean").repartition(3)
    taken = splitting.working_set(df, "id", F.col("hard"), size).collect()
    by_hash = lambda keys: sorted(keys, key=key_hash)
    num_hard = min(hard, max(-(-size // 5), size - easy))
    num_easy = min(easy, size - num_hard, num_hard * 4)
    assert {r.id for r in taken if r.hard} == set(by_hash(range(hard))[:num_hard])
    assert {r.id for r in taken if not r.hard} == set(by_hash(range(1000, 1000 + easy))[:num_easy])


def test_working_set_keeps_copies_together(spark):
    df = spark.createDataFrame([(i, True) for i in range(4) for _ in range(5)] + [(9, False)] * 30, "id int, hard boolean")
    taken = splitting.working_set(df, "id", F.col("hard"), 12, 0.5).collect()
    assert {sum(r.id == i for r in taken) for i in range(4)} <= {0, 5} and 0 < sum(r.hard for r in taken) <= 6


RULES = [
    ("p", "name", "Name", r"\S.*", "text", "none", 0.4, 0.3),
    ("p", "name", None, r"^[A-Z]{2,}$", "text", "none", 0.0, 0.3),
    ("p", "day", None, r"\d+-\d+-\d+", "date", "date", 0.0, 0.0),
    ("p", "way", None, r"[A-Z]+ ?至 ?[A-Z]+", "route", "route", 0.0, None),
    ("q", "name", None, r".+", "compact", "none", 0.0, 0.0),
]


def found(spark, docs):
    table = spark.createDataFrame(RULES, candidates.RULE_SCHEMA)
    return candidates.candidates(lines.with_rows(docs), table, F.lit(AS_OF).cast("date"))


def test_candidates_are_recalled_scored_and_normalised(spark, make_docs):
    docs = make_docs([
        ("a", "p", [("Name:  li", 0.5, box(0, 0, 10, 10)), ("NEAR", 0.5, box(0, 50, 10, 60)), ("FAR", 0.5, box(0, 550, 10, 560)), ("2024-1-5 or 2024-2-30 or 2030-1-1", 1.0), ("A 至 B", 0.0), ("C至C", 1.0)]),
        ("b", "p", ["name", "below", "Name"]), ("c", "q", ["x y", " "]), ("d", "other", ["Name: z"]), ("e", "p", None), ("f", "p", []),
    ])
    rows = {(r.doc_id, r.field, r.value): r for r in found(spark, docs).collect()}
    assert {k[0] for k in rows} == {"a", "b", "c"}
    assert rows["a", "name", "li"].score == pytest.approx(0.4 + 0.4 + 0.3 + 0.1) and rows["a", "name", "li"].anchored
    assert rows["a", "name", "NEAR"].score == pytest.approx(0.4 + 0.3 / 2 + 0.1) and rows["a", "name", "FAR"].score == pytest.approx(0.4 + 0.3 / 12 + 0.1)
    assert {v: (rows["a", "day", v].valid, rows["a", "day", v].score) for v in ("2024-01-05", "2024-02-30", "2030-01-01")} == {
        "2024-01-05": (True, pytest.approx(0.6)), "2024-02-30": (False, pytest.approx(0.2)), "2030-01-01": (False, pytest.approx(0.2))}
    assert (rows["a", "way", "A-B"].valid, rows["a", "way", "C-C"].valid) == (True, False)
    assert {k: r.line_no for k, r in rows.items() if k[0] == "b"} == {("b", "name", "below"): 2}
    assert rows["c", "name", "XY"].line_no == 1
    best = {(r.doc_id, r.field): (r.value, r.lead) for r in candidates.chosen(found(spark, docs)).collect()}
    assert best["a", "name"] == ("li", pytest.approx(0.55)) and best["a", "way"][0] == "A-B" and best["b", "name"] == ("below", None)
    assert candidates.ranked(found(spark, docs), 1).where("doc_id = 'a'").count() == 3
    assert found(spark, make_docs([])).collect() == []


def test_equal_candidates_go_to_the_greater_value(spark, make_docs):
    docs = make_docs([("a", "p", ["AA", "BB", "AA"])])
    assert [(r.value, r.line_no) for r in candidates.ranked(found(spark, docs)).orderBy("rank").collect()] == [("BB", 2), ("AA", 1)]


def test_queue_shows_candidates(spark, make_docs):
    docs = process.process(make_docs([("a", "p", ["AA", "BB"]), ("b", "p", ["-"])]), as_of=AS_OF, keep_unrouted=True)
    queue = review.review_queue(docs.withColumn("decision", F.lit("review")))
    ranked = candidates.ranked(found(spark, docs.select("doc_id", "plugin", "lines", "text")))
    shown = {r.doc_id: [(c.field, c.rank, c.value) for c in r.candidates] for r in review.with_candidates(queue, ranked).collect()}
    assert shown == {"a": [("name", 1, "BB"), ("name", 2, "AA")], "b": []}


KINDS = [
    ("card", 1, True, "china_id", ["name", "name", "seal"], [("blur", 0.5, 0.8)]),
    ("card", 3, True, "passport", ["surname", "seal"], [("blur", 0.2, 0.4), ("glare", 0.5, 0.5)]),
    ("gone", 1, True, "passport", ["surname"], []), ("gone", 2, False, "passport", ["surname"], []),
    ("odd", 1, True, "nobody", ["x"], []), ("passport", 1, True, None, None, None), (None, 1, True, "passport", None, None),
]


def test_kinds_are_routed_by_their_last_version(spark, make_docs):
    """A family added by rows alone is routed, read and measured."""
    kinds = spark.createDataFrame(KINDS, registry.KIND_SCHEMA)
    body = GOLDENS["passport_lines"][1]
    docs = make_docs([(f"{plugin}{k}", plugin, body) for k, plugin in enumerate(["card", "gone", "odd", "passport", "new", None])] + [("card9", "card", ["x"])])
    rows = {r.doc_id: r for r in registry.process_kinds(docs, kinds, as_of=AS_OF).collect()}
    assert {i: (r.kind_version, r.plugin, r.accepted) for i, r in rows.items()} == {
        "card0": (3, "passport", True), "card9": (3, "passport", False), "gone1": (None, None, False), "odd2": (1, None, False),
        "passport3": (1, "passport", True), "new4": (None, None, False), "None5": (None, None, False)}
    assert [i.code for i in rows["gone1"].issues] == ["missing_plugin"]
    done = registry.completeness(registry.process_kinds(docs, kinds, as_of=AS_OF), kinds)
    assert {(r.kind, r.field): (r.num_documents, r.num_present) for r in done.collect()} == {("card", "surname"): (2, 1), ("card", "seal"): (2, 0)}
    scores = spark.createDataFrame([("card", {"blur": 0.1}), ("card", {"blur": 0.3}), ("card", {"glare": 0.5}), ("passport", {"blur": 0.0}), ("new", {}), (None, {})], "plugin string, quality map<string,double>")
    assert sorted((str(r.plugin), r.route, r.passed, r.reasons) for r in registry.quality_route(scores, kinds).collect()) == [
        ("None", "review", False, ["no_rules"]), ("card", "enhanced", False, ["blur"]), ("card", "normal", True, []), ("card", "review", False, ["glare"]),
        ("new", "review", False, ["no_rules"]), ("passport", "review", False, ["no_rules"])]


def test_shipped_kinds_are_the_families(spark, make_docs):
    kinds = registry.shipped_kinds(spark)
    docs = make_docs([(name, plugin, body) for name, (plugin, body, _) in GOLDENS.items()])
    mine = {r.doc_id: (r.plugin, r.accepted, r.field_values) for r in registry.process_kinds(docs, kinds, as_of=AS_OF).collect()}
    assert mine == {r.doc_id: (r.plugin, r.accepted, r.field_values) for r in process.process(docs, as_of=AS_OF).collect()}
    assert {r.name for r in families.registered(spark).collect()} == set(families.names())


def test_causes_by_table(spark):
    issues = spark.createDataFrame([("p", "missing_x"), ("p", "odd"), ("q", "odd"), ("q", "new"), (None, "odd"), ("p", None)], "plugin string, code string")
    causes = spark.createDataFrame([("odd", "one", None), ("odd", "two", "q"), ("odd", "two", "q"), ("missing_x", "named", "q")], "code string, root_cause string, plugin string")
    rows = {(r.plugin, r.code): (r.root_cause, r.num_issues) for r in review.failures_by_cause(issues, causes).collect()}
    assert rows == {("p", "missing_x"): ("parser_error", 1), ("p", "odd"): ("one", 1), ("q", "odd"): ("two", 1), ("q", "new"): ("unclassified", 1), (None, "odd"): ("one", 1), ("p", None): ("unclassified", 1)}


def test_vocabularies(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1), (None, None)], "x string, y int")
    checked = merging.vocabulary_violations(rows, {"x": ["a", "c"], "y": [0, 90]}).collect()
    assert [r.violations for r in checked] == [[], ["x", "y"], ["x", "y"]]
