import pytest

from formgrain import families
from pyspark.sql import functions as F

from .goldens import GOLDENS, box


def read(make_docs, plugin, body, as_of="2026-01-01", patch=None):
    family = families.get(plugin)
    docs = families.extract(make_docs([("d", plugin, body)]), family)
    for name, value in (patch or {}).items():
        docs = docs.withColumn("fields", F.col("fields").withField(name, F.lit(value)))
    row = families.validate(docs, family, as_of).collect()[0]
    return row.fields.asDict(), [i.code for i in row.issues], row


@pytest.mark.parametrize("name", sorted(GOLDENS))
def test_golden_fields(make_docs, name):
    plugin, body, expected = GOLDENS[name]
    fields, _, _ = read(make_docs, plugin, body)
    assert {k: fields[k] for k in expected} == expected


def id_card(number):
    return ["姓名张三", f"公民身份号码{number}"]


@pytest.mark.parametrize("number, codes", [
    ("110101199003074514", []),
    ("11010119900101100x", []),
    ("110105201001011232", []),
    ("000000199001011234", ["region_code_invalid", "checksum_invalid"]),
    ("31010119881201242X", ["checksum_invalid"]),
    ("110105201001011231", ["checksum_invalid"]),
    ("110101205001011234", ["birth_date_invalid", "checksum_invalid"]),
    ("110101199002301234", ["birth_date_invalid", "checksum_invalid"]),
    ("110101000001011234", ["birth_date_invalid", "checksum_invalid"]),
])
def test_id_number_codes(make_docs, number, codes):
    _, got, row = read(make_docs, "china_id", id_card(number))
    assert got == codes
    assert row.accepted is (not codes) and row.score == (0.0 if codes else 1.0)


def test_id_number_shapes(make_docs):
    for number, code in [("12345", "length_invalid"), ("1101011990030745AB", "format_invalid"), (None, "missing_id_number")]:
        _, got, _ = read(make_docs, "china_id", id_card("110101199003074514"), patch={"id_number": number})
        assert got == [code]


def test_back_side_is_rejected_unless_asked(make_docs, spark):
    from formgrain.families.base import Family
    from formgrain.families.china_id import china_id_side_rules, extract_china_id

    body = GOLDENS["id_back"][1]
    assert read(make_docs, "china_id", body)[1] == ["missing_id_number"]
    lenient = Family("china_id", extract_china_id, china_id_side_rules)
    row = families.validate(families.extract(make_docs([("d", "china_id", body)]), lenient), lenient).collect()[0]
    assert row.accepted and not row.issues


def test_id_last_match_and_loose_validity(make_docs):
    fields, _, _ = read(make_docs, "china_id", ["性别男民族汉", "性别女", "民族回", "住址 A路", "姓名", "1号", "住址B", "身份证号码1"])
    assert (fields["gender"], fields["ethnicity"], fields["address"]) == ("女", "回", "A路1号B")
    fields, _, _ = read(make_docs, "china_id", ["签发机关", "签发机关 某局", "有效期限: 2001-2002", "有效期限2003"])
    assert (fields["issuing_authority"], fields["valid_from"], fields["valid_to"]) == ("某局", "2003", "2002")
    fields, _, _ = read(make_docs, "china_id", ["签发机关某局", "有效期限 2001-2002", "20100101 至 长期", "有效期限2009"])
    assert (fields["valid_from"], fields["valid_to"]) == ("20100101", "长期")


def test_wide_blanks_are_stripped(make_docs):
    fields, _, _ = read(make_docs, "china_id", ["　姓名　王　五　", "  ", "　"])
    assert fields["name"] == "王五"


def test_mrz_checks(make_docs):
    good = GOLDENS["passport_lines"][1]
    assert read(make_docs, "passport", good)[1] == []
    bad = [good[0], good[1].replace("L898902C36", "L898902C46")]
    assert read(make_docs, "passport", bad)[1] == ["passport_number_check_failed", "final_check_failed"]
    assert read(make_docs, "passport", ["nothing here"])[1] == ["missing_mrz_lines"]
    _, codes, row = read(make_docs, "passport", good, patch={"passport_number": "X898902C3"})
    assert codes == ["passport_number_mismatch"] and not row.accepted


def test_mrz_pair_prefers_the_opening_line(make_docs):
    filler = "A" * 44
    first = GOLDENS["passport_lines"][1][0].replace(" ", "")
    second = GOLDENS["passport_lines"][1][1].replace(" ", "")
    fields, _, _ = read(make_docs, "passport", [filler, first, "noise", second])
    assert fields["mrz_lines"] == [first, second]
    fields, _, _ = read(make_docs, "passport", [filler, second, first])
    assert fields["mrz_lines"] == [filler, second]
    assert read(make_docs, "passport", [first])[0]["mrz_lines"] == []


def test_booklet_rules(make_docs):
    base = ["户主: 甲", "姓名: 乙", "出生日期: 2012年7月9日"]
    _, codes, row = read(make_docs, "hukou_booklet", base)
    assert codes == ["missing_household_id", "missing_id_number"] and row.accepted and row.score == 0.8
    _, codes, row = read(make_docs, "hukou_booklet", ["姓名: 乙", "户号: 123456", "身份证号: 110105201001011231"])
    assert codes == ["checksum_invalid"] and row.score == 0.0
    _, codes, _ = read(make_docs, "hukou_booklet",
                       ["姓名: 乙", "户号: 123456", "身份证号: 110105201001011232", "出生日期: 2010-01-02", "性别: 未知", "关系: 邻居"])
    assert codes == ["invalid_gender", "invalid_relation_to_head", "birth_date_mismatch"]
    _, codes, _ = read(make_docs, "hukou_booklet", ["nothing"])
    assert codes == ["missing_member_name", "missing_household_id"]


def test_booklet_text_and_wide_colons(make_docs):
    fields, _, _ = read(make_docs, "hukou_booklet", "出生日期: 2012年7月9日\n性别: Female\n\n住址：　某路\n户号 编码 778899")
    assert fields["birth_date"] == "2012-07-09" and fields["gender"] == "女" and fields["address"] == "某路"
    assert fields["household_id"] == "778899"
    fields, _, _ = read(make_docs, "hukou_booklet", ["出生日期: 2012年7月9日生"])
    assert fields["birth_date"] is None


def test_label_at_the_end_keeps_scanning(make_docs):
    fields, _, _ = read(make_docs, "hukou_booklet", ["NAME: ", "Name: 乙", "住址"])
    assert fields["member_name"] == "Name: 乙" and fields["address"] is None


def test_record_values(make_docs):
    fields, codes, row = read(make_docs, "medical_record", ["SEX: Female", "AGE: about 40 years", "RX: a, b;;c", "seen 2026/3/1 today"])
    # Deliberate deviation: "Female" is read as female although it contains "male".
    assert (fields["gender"], fields["age"], fields["visit_date"]) == ("女", "40", "2026-03-01")
    assert fields["medications"] == ["a", "b", "c"] and fields["diagnosis"] == []
    assert codes == ["missing_patient_name"] and row.score == 0.5
    fields, codes, _ = read(make_docs, "medical_record", ["姓名: x", "日期: later", "2026-03-01"])
    assert fields["visit_date"] is None and codes == ["missing_visit_date"]
    assert read(make_docs, "medical_record", ["性别: 男性"])[0]["gender"] == "男"
    assert read(make_docs, "medical_record", ["a", "b", "c", "市医院"])[0]["hospital_name"] is None


def test_ticket_rules(make_docs):
    assert len(read(make_docs, "train_ticket", [])[1]) == 5
    _, codes, _ = read(make_docs, "boarding_pass", GOLDENS["boarding_inline"][1],
                       patch={"arrival_airport": "TAIYUAN"})
    assert codes == ["same_departure_arrival"]


def test_names_without_anchor_follow_the_score(make_docs):
    body = [("LI LEI", 0.5, box(0, 0, 1, 1)), ("WANG WU", 0.9, box(5, 5, 6, 6)), ("ANTON X", 0.99, box(0, 0, 1, 1))]
    assert read(make_docs, "boarding_pass", body)[0]["passenger_name"] == "WANG WU"
    assert read(make_docs, "train_ticket", ["AAAAA", "BBBBB"])[0]["passenger_name"] == "AAAAA"


def test_train_number_takes_first_hit_per_line(make_docs):
    body = [("2026-03-11 G99", 0.9), ("K5", 0.5), ("T7", 0.5)]
    assert read(make_docs, "train_ticket", body)[0]["train_number"] == "T7"


def test_flight_number_over_a_line_end(make_docs):
    assert read(make_docs, "boarding_pass", ["MU", "2379"])[0]["flight_number"] == "MU\n2379"


def test_no_python_in_the_plans_and_no_shuffle(make_docs):
    for name in families.names():
        family = families.get(name)
        docs = families.validate(families.extract(make_docs([("d", name, ["x"])]), family), family)
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "Exchange" not in plan
