"""Word lists, label aliases, gazetteers, weights and formats.

Every value here is part of the data contract. Callers extend a list by passing
their own to the function that takes it.
"""

from __future__ import annotations

# Characters that count as white space in document text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LOOSE_BLANKS = r"(?U)(?: [\s\x1c-\x1f]|[\s\x1c-\x1f&&[^ ]])[\s\x1c-\x1f]*"
LABEL_PADDING = " :："
FULLWIDTH_DIGITS = "０１２３４５６７８９"

# Resident identity card.
ID_NUMBER = r"(?U)\d{17}[0-9Xx]"
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_CHECK_CHARS = "10X98765432"
PROVINCE_CODES = [
    "11", "12", "13", "14", "15",
    "21", "22", "23",
    "31", "32", "33", "34", "35", "36", "37",
    "41", "42", "43", "44", "45", "46",
    "50", "51", "52", "53", "54",
    "61", "62", "63", "64", "65",
    "71", "81", "82",
]
ID_BACK_MARKS = ["签发机关", "有效期限"]
ID_FRONT_MARK = "公民身份号码"
ID_NUMBER_LABELS = ["公民身份号码", "身份证号码"]
ID_BARE_LABELS = ["姓名", "性别", "民族", "出生"]
ID_GENDER = r"性别([男女])"
ID_ETHNICITY = r"民族([一-龥]{1,4})"
VALIDITY_RANGE = r"(?U)(\d{4}\.\d{2}\.\d{2}|\d{8})\s*[-—一至]\s*(长期|\d{4}\.\d{2}\.\d{2}|\d{8})"
VALIDITY_SEPARATOR = "[-—一至]"

# Machine-readable zone of a passport.
MRZ_LINE = r"^[A-Z0-9<]{44}\z"
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MRZ_WEIGHTS = [7, 3, 1]
MRZ_COMPARED_FIELDS = [
    "passport_number", "issuing_country", "nationality", "surname",
    "given_names", "birth_date", "expiry_date", "sex",
]

# Household booklet.
BOOKLET_ALIASES = {
    "household_id": ["户号", "HOUSEHOLD ID"],
    "householder_name": ["户主姓名", "户主", "HOUSEHOLDER", "HEAD OF HOUSEHOLD"],
    "address": ["住址", "ADDRESS"],
    "member_name": ["姓名", "成员姓名", "NAME"],
    "relation_to_head": ["与户主关系", "关系", "RELATIONSHIP"],
    "gender": ["性别", "SEX", "GENDER"],
    "birth_date": ["出生日期", "出生年月日", "BIRTH DATE", "DATE OF BIRTH"],
    "id_number": ["公民身份号码", "身份证号", "身份证号码", "ID NUMBER"],
}
HOUSEHOLD_ID = r"(?U)\d{6,12}"
BOOKLET_ID_NUMBER = r"(?U)\d{17}[\dXx]"
RELATION_TOKENS = [
    "户主", "之妻", "之夫", "之子", "之女", "子", "女",
    "孙子", "孙女", "父亲", "母亲", "配偶", "非亲属",
]
GENDERS = ["男", "女"]

# Medical record.
RECORD_ALIASES = {
    "hospital_name": ["医院", "医院名称", "HOSPITAL"],
    "patient_name": ["姓名", "患者姓名", "NAME"],
    "gender": ["性别", "SEX", "GENDER"],
    "age": ["年龄", "AGE"],
    "visit_date": ["就诊日期", "日期", "就诊时间", "VISIT DATE", "DATE"],
    "department": ["科别", "科室", "门诊", "DEPARTMENT"],
    "diagnosis": ["诊断", "初步诊断", "DIAGNOSIS"],
    "medications": ["用药", "药品", "处方", "MEDICATION", "RX"],
    "notes": ["主诉", "病史", "备注", "NOTES", "NOTE"],
}
AGE_YEARS = r"(?U)(\d{1,3})\s*岁"
ITEM_SEPARATOR = r"(?U)[；;、,，]\s*"

# Dates written with separators or with 年 月 日.
DATE_TEXT = r"(?U)\b(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?\b"

# Tickets.
FLIGHT_NUMBER = r"(?U)\b([A-Z]{1,2}[\s\x1c-\x1f]?\d{3,4})\b"
TICKET_NUMBER = r"(?iU)ETKT[\s\x1c-\x1f]?(\d{10,14}(?:/\d)?)"
GATE = r"(?U)\bG\d{1,2}\b"
FLIGHT_DATE = r"(?U)\b\d{2}[A-Z]{3}\b"
TRAIN_DEPARTURE = r"(?U)\b\d{2}[A-Z]{3}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{2}:\d{2}\b"
TRAIN_NUMBER = r"(?U)\b([GDCZTKYLSP]?\d{1,4})\b"
LATIN_LINE = r"(?U)^[A-Z][A-Z\s\x1c-\x1f]{4,}\z"
PERSON_NAME = r"^[A-Z][A-Z ]{4,24}\z"
AIRPORTS = ["TAIYUAN", "FUZHOU", "SHANGHAI", "HANGZHOU", "BEIJING", "GUANGZHOU"]
TRAIN_STATIONS = ["SHANGHAI", "HANGZHOU", "BEIJING", "GUANGZHOU", "NANJING", "SUZHOU", "WUHAN"]
NAME_ANCHORS = ["姓名", "NAME"]
NAME_EXCLUDED_PARTS = ["FLIGHT", "DATE", "GATE", "ETKT", "TKTNO", "SEAT", "FROM", "TO"]
BOARDING_STOPWORDS = [
    "BOARDING PASS", "BOARDING", "PASS", "SERIAL NO", "SEAT NO",
    "FLIGHT", "DATE", "CLASS", "NAME", "NAME NAME",
]
TRAIN_STOPWORDS = ["BOARDING PASS", "BOARDING", "PASS", "FLIGHT", "DATE", "CLASS", "NAME", "FROM", "TO"]
NAME_MAX_LENGTH = 24
FAR_AWAY = 1e9

# Required fields of the two ticket families.
BOARDING_REQUIRED = ["flight_number", "ticket_number", "departure_date", "departure_airport", "arrival_airport"]
TRAIN_REQUIRED = ["ticket_number", "train_number", "departure_station", "arrival_station", "departure_time"]

# Configured field lists per family, used by the completeness report.
EXPECTED_FIELDS = {
    "boarding_pass": [
        "passenger_name", "flight_number", "ticket_number", "departure_date",
        "departure_airport", "arrival_airport", "gate", "seat_no",
    ],
    "hukou_booklet": [
        "household_id", "householder_name", "address", "member_name",
        "relation_to_head", "gender", "birth_date", "id_number",
    ],
    "medical_record": [
        "hospital_name", "patient_name", "gender", "age", "visit_date",
        "department", "diagnosis", "medications", "notes",
    ],
    "train_ticket": [
        "ticket_number", "passenger_name", "id_number", "train_number", "departure_station",
        "arrival_station", "departure_time", "seat_no", "fare",
    ],
}

# Image quality rules per family.
QUALITY_RULES = {
    "boarding_pass": ["blur", "glare", "cropped"],
    "hukou_booklet": ["blur", "glare", "shadow", "page_curvature"],
    "medical_record": ["blur", "glare", "cropped"],
    "train_ticket": ["blur", "low_contrast", "cropped"],
}

# Closed vocabularies.
FIELD_SOURCES = ["template_ocr", "mrz", "barcode", "vlm_fallback", "manual"]
SEVERITIES = ["info", "warning", "error"]
ANGLES = [0, 90, 180, 270]
SOURCE_PRIORITY = ["vlm_fallback", "barcode", "template_ocr", "mrz", "manual"]
