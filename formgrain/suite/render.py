"""Documents rendered from the star schema, so that every family has input that grows with the tables.

Rendering is a projection of table rows to recognised lines. It plants faults on a fixed
rhythm of the key (wrong check digits, dropped labels, other spellings) so that rejections occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import id_check_char, mrz_check_digit, mrz_values
from ..functions.structs import built_once

AS_OF = "2026-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the session's shuffle partitions, whatever the table's size: extraction is heavy per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def line(text: Column | str, score: Column | float = 0.9, box: Column | None = None) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    score = F.lit(score) if isinstance(score, float) else score
    box = F.lit(None).cast("array<array<double>>") if box is None else box
    return F.struct(box.alias("box"), text.alias("text"), score.alias("score"))


def lines(*parts: Column) -> Column:
    """Array of the lines that are there."""
    return F.filter(F.array(*parts), lambda l: l.isNotNull())


def quad(x1: Column, y1: Column, width: int = 60, height: int = 10) -> Column:
    x, y = x1.cast("double"), y1.cast("double")
    return F.array(
        F.array(x, y), F.array(x + float(width), y),
        F.array(x + float(width), y + float(height)), F.array(x, y + float(height)),
    )


def choose(values: list[str], key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def digits(key: Column, width: int) -> Column:
    return F.lpad(key.cast("string"), width, "0")


def days_from(day: str, offset: Column) -> Column:
    return F.date_add(F.lit(day).cast("date"), offset.cast("int"))


# --- identity numbers ------------------------------------------------------------------------

REGIONS = ["110101", "310115", "320102", "330106", "440103", "000000", "990101"]


def birth_day(k: Column) -> Column:
    return days_from("1950-01-01", (k * 37) % 20000)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("doc_id"), "c_name", F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )


def numbered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a right identity number and the written one: one in five has a wrong check character."""
    k = F.col("doc_id")
    born = F.when(k % 11 == 4, F.lit("19990230")).otherwise(F.date_format(birth_day(k), "yyyyMMdd"))
    body = customers(spark, sf_dir).withColumn("body", F.concat(choose(REGIONS, k), born, digits(k % 1000, 3)))
    checked = body.withColumn("good", id_check_char(F.col("body")))
    wrong = F.when(F.col("good") == "1", F.lit("0")).otherwise(F.lit("1"))
    return checked.withColumn("right_idn", F.concat("body", "good")).withColumn(
        "idn", F.concat("body", F.when(k % 5 == 0, wrong).otherwise(F.col("good")))
    )


@built_once
def _id_cards_columns() -> list:
    k = F.col("doc_id")
    return [
        "doc_id", "segment", F.lit("china_id").alias("plugin"),
        lines(
            line("中华人民共和国居民身份证"),
            F.when(k % 13 != 6, line(F.concat(F.lit("姓名 "), F.col("c_name")))),
            line(F.concat(F.lit("性别 "), choose(["女", "男"], k), F.lit(" 民族 汉"))),
            line(F.concat(F.lit("出生 "), F.date_format(birth_day(k), "yyyy'年'MM'月'dd'日'"))),
            line(F.concat(F.lit("住址 "), F.col("segment"))),
            line(F.concat(F.lit("No "), F.col("nation").cast("string"))),
            F.when(k % 17 != 9, line(F.concat(F.lit("公民身份号码 "), F.lower("idn")))),
        ).alias("lines"),
    ]


def id_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_customers(spark, sf_dir).select(*_id_cards_columns())


@built_once
def _id_backs_columns() -> list:
    k = F.col("s_suppkey")
    start = days_from("2001-01-01", k % 5000)
    span = (
        F.when(k % 3 == 0, F.concat(F.date_format(start, "yyyy.MM.dd"), F.lit(" - "), F.lit("2030.01.01")))
        .when(k % 3 == 1, F.concat(F.date_format(start, "yyyyMMdd"), F.lit("至长期")))
        .otherwise(F.concat(F.date_format(start, "yyyy"), F.lit("-2031")))
    )
    return [
        k.alias("doc_id"), F.lit("china_id").alias("plugin"),
        lines(
            line("中华人民共和国居民身份证"),
            line(F.concat(F.lit("签发机关: "), F.col("s_name"))),
            line(F.concat(F.lit("有效期限 "), span)),
        ).alias("lines"),
    ]


def id_backs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier")).select(*_id_backs_columns())


# --- passports -------------------------------------------------------------------------------


def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    check = lambda c: mrz_check_digit(mrz_values(c))
    shift = lambda d: ((d.cast("int") + 1) % 10).cast("string")
    nation = F.concat(F.lit("N"), F.translate(digits(F.col("nation"), 2), "0123456789", "ABCDEFGHIJ"))
    number = F.concat(F.lit("C"), digits(k % 10000000, 7), F.lit("<"))
    born, until = F.date_format(birth_day(k), "yyMMdd"), F.date_format(days_from("2020-01-01", k % 4000), "yyMMdd")
    personal = F.rpad(F.concat(F.lit("ZE"), digits(k, 9)), 14, "<")
    staged = customers(spark, sf_dir).select(
        "doc_id", nation.alias("nation"), number.alias("number"), born.alias("born"), until.alias("until"),
        personal.alias("personal"), F.col("segment"),
    )
    staged = staged.select(
        "*", check(F.col("number")).alias("c1"), check(F.col("born")).alias("c2"),
        check(F.col("until")).alias("c3"), check(F.col("personal")).alias("c4"),
    )
    staged = staged.withColumn("c5", check(F.concat("number", "c1", "born", "c2", "until", "c3", "personal", "c4")))
    first = F.rpad(F.concat(F.lit("P<"), F.col("nation"), F.lit("CUSTOMER<<"), F.col("segment")), 44, "<")
    second = F.concat(
        "number", F.when(k % 6 == 1, shift(F.col("c1"))).otherwise(F.col("c1")), "nation",
        "born", F.when(k % 6 == 2, shift(F.col("c2"))).otherwise(F.col("c2")),
        choose(["F", "M", "<"], k), "until", "c3", "personal", "c4", "c5",
    )
    spaced = F.concat(F.substring(first, 1, 5), F.lit(" "), F.lower(F.substring(first, 6, 39)))
    return staged.select(
        "doc_id", F.lit("passport").alias("plugin"),
        lines(
            line("Passport"),
            F.when(k % 4 == 0, line("A" * 44)),
            F.when(k % 9 != 4, line(F.translate(spaced, "<", "«"))),
            line("noise"),
            F.when(k % 9 != 4, line(second)),
        ).alias("lines"),
    )


def passport_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values typed in by hand: a differing number for some, an explicit null for others, repeated rows."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    k = F.col("doc_id")
    return base.select(
        "doc_id",
        F.explode(
            F.filter(
                F.array(
                    F.when(k % 8 == 3, F.struct(F.lit("passport_number").alias("field"), F.lit("OLD").alias("value"), F.lit(1).alias("seq"))),
                    F.when(k % 8 == 3, F.struct(F.lit("passport_number").alias("field"), F.concat(F.lit("X"), digits(k, 7)).alias("value"), F.lit(2).alias("seq"))),
                    F.when(k % 8 == 5, F.struct(F.lit("surname").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("seq"))),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("o"),
    ).select("doc_id", "o.*")


# --- household booklets ----------------------------------------------------------------------

RELATIONS = ["之子", "之女", "邻居", "配偶"]


@built_once
def _booklets_columns() -> list:
    k = F.col("doc_id")

    def pair(label: str, value: Column) -> list[Column]:
        """Label and value on one line with either colon, or on two lines."""
        return [
            F.when(k % 3 == 0, line(F.concat(F.lit(label + ": "), value)))
            .when(k % 3 == 1, line(F.concat(F.lit(label + "："), value)))
            .otherwise(line(label)),
            F.when(k % 3 == 2, line(value)),
        ]

    return [
        "doc_id", "segment", F.lit("hukou_booklet").alias("plugin"),
        F.filter(
            F.array(
                line("常住人口登记卡"),
                *pair("户号", F.concat(digits(k, 9), F.lit(" 号"))),
                *pair("户主姓名", F.col("c_name")),
                *pair("住址", F.concat(F.col("segment"), F.lit(" 8"))),
                *[F.when(k % 7 != 5, p) for p in pair("姓名", F.concat(F.lit("M"), k.cast("string")))],
                *pair("与户主关系", choose(RELATIONS, k)),
                *pair("Sex", choose(["Female", "male", "未知"], F.floor(k / 3))),
                *[F.when(k % 4 == 1, p) for p in pair("出生日期", F.date_format(birth_day(k), "yyyy'年'M'月'd'日'"))],
                *[F.when(k % 5 != 2, p) for p in pair("身份证号", F.lower("idn"))],
            ),
            lambda l: l.isNotNull(),
        ).alias("lines"),
    ]


def booklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_customers(spark, sf_dir).select(*_booklets_columns())


# --- medical records -------------------------------------------------------------------------


@built_once
def _records_columns() -> list:
    k = F.col("p_partkey")
    day = days_from("2024-01-01", k % 700)
    return [
        k.alias("doc_id"), F.lit("medical_record").alias("plugin"),
        lines(
            line(F.concat(F.lit("市第"), k.cast("string"), F.lit("医院"))),
            F.when(k % 9 != 1, line(F.concat(F.lit("姓名: "), F.col("p_name")))),
            line(F.concat(F.lit("gender: "), choose(["Female", "Male", "男性", "女"], k))),
            line(F.concat(F.lit("年龄: "), (k % 90).cast("string"), choose([" 岁", "", " years"], k))),
            F.when(k % 4 != 2, line(F.concat(F.lit("就诊日期: "), F.date_format(day, "yyyy年M月d日")))),
            F.when(k % 8 == 2, line(F.concat(F.lit("seen "), F.date_format(day, "yyyy/MM/dd"), F.lit(" again")))),
            line(F.concat(F.lit("DEPARTMENT："), F.col("p_type"))),
            line(F.concat(F.lit("诊断: "), F.col("p_name"), F.lit("； "), F.col("p_type"), F.lit(";;"))),
            F.when(k % 6 != 3, line(F.concat(F.lit("RX: "), F.col("p_brand"), F.lit("、size "), F.col("p_size").cast("string")))),
            line("备注"),
            line(F.concat(F.lit("price "), F.col("p_size").cast("string"))),
        ).alias("lines"),
    ]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part")).select(*_records_columns())


# --- tickets ---------------------------------------------------------------------------------

NAMES = ["LI LEI", "WANG WU", "ZHANG WEI", "CHEN JING", "ZHAO MIN"]
CITIES = ["TAIYUAN", "FUZHOU", "SHANGHAI", "HANGZHOU", "BEIJING", "GUANGZHOU"]
STATIONS = ["SHANGHAI", "HANGZHOU", "BEIJING", "GUANGZHOU", "NANJING", "SUZHOU", "WUHAN"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def _name_lines(k: Column) -> list[Column]:
    """Two names: the first is nearer to the anchor for even keys, the second for odd ones."""
    near, far = F.lit(70), F.lit(200)
    first_x = F.when(k % 2 == 0, near).otherwise(far)
    second_x = F.when(k % 2 == 0, far).otherwise(near)
    return [
        line(choose(NAMES, k), 0.8, quad(first_x, F.lit(60))),
        line(choose(NAMES, k + 1), 0.95, quad(second_x, F.lit(60))),
    ]


@built_once
def _boarding_passes_columns() -> list:
    k = F.col("o_orderkey")
    date = F.concat(F.date_format("o_orderdate", "dd"), choose(MONTHS, F.month("o_orderdate") - 1))
    return [
        k.alias("doc_id"), F.lit("boarding_pass").alias("plugin"),
        lines(
            line("BOARDING PASS", 0.99, quad(F.lit(0), F.lit(0))),
            F.when(k % 10 != 7, line(date, 0.99, quad(F.lit(0), F.lit(20)))),
            line(F.concat(F.lit("MU "), (1000 + k % 9000).cast("string")), 0.99, quad(F.lit(50), F.lit(20))),
            line(choose(CITIES, k), 0.99, quad(F.lit(0), F.lit(40))),
            # One in six names the same city twice, which leaves no arrival.
            line(choose(CITIES, k + F.floor(k / 6) % 6), 0.99, quad(F.lit(70), F.lit(40))),
            F.when(k % 5 != 4, line("姓名 NAME", 0.99, quad(F.lit(0), F.lit(60)))),
            *_name_lines(k),
            F.when(k % 8 != 3, line(F.concat(F.lit("etkt "), digits(k, 13), F.lit("/1")), 0.99, quad(F.lit(0), F.lit(80)))),
            line(F.concat(F.lit("G"), (k % 100).cast("string")), 0.99, quad(F.lit(150), F.lit(20))),
        ).alias("lines"),
    ]


def boarding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).select(*_boarding_passes_columns())


@built_once
def _train_tickets_columns() -> list:
    k = F.col("o_orderkey")
    return [
        k.alias("doc_id"), F.lit("train_ticket").alias("plugin"),
        lines(
            line("中国铁路客票", 0.99, quad(F.lit(0), F.lit(0))),
            line(F.concat(choose(["G", "D", "K"], k), (1 + k % 999).cast("string")), 0.9, quad(F.lit(0), F.lit(30))),
            line(F.concat(choose(["Z", "T"], k), (1 + k % 99).cast("string")), (0.5 + (k % 2) * 0.45).cast("double"), quad(F.lit(90), F.lit(30))),
            F.when(k % 6 != 1, line(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 07:45")), 0.99, quad(F.lit(50), F.lit(30)))),
            F.when(k % 6 == 1, line("08:30", 0.99, quad(F.lit(50), F.lit(30)))),
            line(choose(STATIONS, k), 0.97, quad(F.lit(0), F.lit(60))),
            line(choose(STATIONS, k + 3), 0.97, quad(F.lit(90), F.lit(60))),
            F.when(k % 5 != 4, line("NAME", 0.98, quad(F.lit(0), F.lit(60)))),
            *_name_lines(k),
            F.when(k % 8 != 3, line(F.concat(F.lit("ETKT "), digits(k, 13)), 0.95, quad(F.lit(0), F.lit(120)))),
        ).alias("lines"),
    ]


def train_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders")).select(*_train_tickets_columns())


def itineraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel sheets on which each value stands twice: under a label in a weak line, and loose in a strong one."""
    k = F.col("doc_id")
    near = lambda x, y: quad(F.lit(x), F.lit(y))
    return numbered_customers(spark, sf_dir).select(
        "doc_id", F.lit("itinerary").alias("plugin"),
        lines(
            F.when(k % 4 != 1, line(F.concat(F.lit("Passenger: "), choose(NAMES, k)), 0.6, near(0, 0))),
            line(F.concat(choose(NAMES, k + 1), F.lit(" checked in")), 0.9, near(300, 0)),
            F.when(k % 17 != 9, line(F.concat(F.lit("ID No: "), F.lower("idn")), 0.5)),
            line(F.concat(F.lit("no "), F.col("right_idn")), 0.9),
            F.when(k % 3 == 0, line("Date", 0.7)),
            F.when(k % 3 == 0, line(F.date_format(days_from("2024-01-01", k % 500), "yyyy年M月d日"), 0.7)),
            F.when(k % 6 == 0, line("printed 2020-02-30", 0.95)).otherwise(line("printed 2020/1/9", 0.3)),
            F.when(k % 5 != 2, line(F.concat(choose(STATIONS, k), F.lit(" - "), choose(STATIONS, k + 3)), 0.8)),
            F.when(k % 5 <= 2, line(F.concat(F.lit("via "), choose(STATIONS, k + 1), F.lit(" → "), choose(STATIONS, k + 2)), 0.4)),
        ).alias("lines"),
    )


#: Rules for travel sheets: (field, anchor, pattern, normal form, check, weight of the anchor, weight of standing near it).
ITINERARY_RULES = [
    ("name", "Passenger", r"[A-Z]+ [A-Z]+", "text", "none", 0.4, 0.1),
    ("name", None, r"^[A-Z]+ [A-Z]+(?= checked in)", "text", "none", 0.0, 0.1),
    ("number", "ID No", r"[0-9]{17}[0-9Xx]", "upper", "id_number", 0.4, 0.0),
    ("number", None, r"[0-9]{17}[0-9Xx]", "upper", "id_number", 0.0, 0.0),
    ("date", "Date", r".+", "date", "date", 0.4, 0.0),
    ("date", None, r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?", "date", "date", 0.0, 0.0),
    ("route", None, r"[A-Z]{4,} ?[-→] ?[A-Z]{4,}", "route", "route", 0.0, 0.0),
]


# --- texts -----------------------------------------------------------------------------------


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source")


def text_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as recognition results: every line of the text, blank ones too, with a score by its length."""
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "lang", "source", "text", F.lit("plain").alias("plugin"),
        F.transform(
            F.split("text", "\n"),
            lambda t: line(t, ((F.length(t) % 50) / 100.0 + 0.5)),
        ).alias("lines"),
    )
