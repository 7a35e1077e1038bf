"""DuckDB twins of the registered queries.

Where documents are rendered, the twin states what must come out for each key, taken from the
rendering rather than from the extraction, so both sides are written independently.
"""

from __future__ import annotations

from ..rules import WHITESPACE

WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
PROVINCES = (
    "'11','12','13','14','15','21','22','23','31','32','33','34','35','36','37','41','42','43','44','45','46',"
    "'50','51','52','53','54','61','62','63','64','65','71','81','82'"
)
NAMES = "['LI LEI','WANG WU','ZHANG WEI','CHEN JING','ZHAO MIN']"
CITIES = "['TAIYUAN','FUZHOU','SHANGHAI','HANGZHOU','BEIJING','GUANGZHOU']"
STATIONS = "['SHANGHAI','HANGZHOU','BEIJING','GUANGZHOU','NANJING','SUZHOU','WUHAN']"


def codes(*pairs: tuple[str, str, str, str]) -> str:
    """List of {code, severity, field} for the (condition, code, severity, field) that hold."""
    items = ", ".join(
        f"CASE WHEN {cond} THEN {{'code': '{code}', 'severity': '{severity}', 'field': '{field}'}} END"
        for cond, code, severity, field in pairs
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


ID_CODES = [
    (f"substr(idn, 1, 2) NOT IN ({PROVINCES})", "region_code_invalid", "error", "id_number"),
    ("(try_strptime(substr(idn, 7, 8), '%Y%m%d') IS NULL OR try_strptime(substr(idn, 7, 8), '%Y%m%d') > TIMESTAMP '2026-01-01')",
     "birth_date_invalid", "error", "id_number"),
    ("substr(idn, 18, 1) <> good", "checksum_invalid", "error", "id_number"),
]

CTES = {
    "cust": """
        SELECT c_custkey AS k, c_name, c_nationkey AS nation, c_mktsegment AS segment,
               DATE '1950-01-01' + CAST((c_custkey * 37) % 20000 AS INTEGER) AS bday
        FROM customer""",
    "idb": """
        SELECT *, ['110101','310115','320102','330106','440103','000000','990101'][k % 7 + 1]
               || CASE WHEN k % 11 = 4 THEN '19990230' ELSE strftime(bday, '%Y%m%d') END
               || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') AS body
        FROM cust""",
    "idc": """
        SELECT *, substr('10X98765432', CAST(1 + list_sum(list_transform(range(1, 18),
               lambda i: CAST(substr(body, i, 1) AS INTEGER) * [7,9,10,5,8,4,2,1,6,3,7,9,10,5,8,4,2][i])) % 11 AS INTEGER), 1) AS good
        FROM idb""",
    "ids": """
        SELECT *, body || CASE WHEN k % 5 = 0 THEN CASE WHEN good = '1' THEN '0' ELSE '1' END ELSE good END AS idn
        FROM idc""",
    "id_issues": f"""
        SELECT k, segment, CASE WHEN k % 17 = 9
               THEN [{{'code': 'missing_id_number', 'severity': 'error', 'field': 'id_number'}}]
               ELSE {codes(*ID_CODES)} END AS issues
        FROM ids""",
    "pass_issues": """
        SELECT k, CASE WHEN k % 9 = 4 THEN [{'code': 'missing_mrz_lines', 'severity': 'error', 'field': 'mrz_lines'}]
               ELSE """ + codes(
        ("k % 6 = 1", "passport_number_check_failed", "error", "mrz"),
        ("k % 6 = 2", "birth_date_check_failed", "error", "mrz"),
        ("k % 6 IN (1, 2)", "final_check_failed", "error", "mrz"),
        ("k % 8 = 3", "passport_number_mismatch", "error", "passport_number"),
    ) + """ END AS issues, k % 9 = 4 AS unread FROM cust""",
    "pass_plain": """
        SELECT k, CASE WHEN k % 9 = 4 THEN [{'code': 'missing_mrz_lines', 'severity': 'error', 'field': 'mrz_lines'}]
               ELSE """ + codes(
        ("k % 6 = 1", "passport_number_check_failed", "error", "mrz"),
        ("k % 6 = 2", "birth_date_check_failed", "error", "mrz"),
        ("k % 6 IN (1, 2)", "final_check_failed", "error", "mrz"),
    ) + """ END AS issues FROM cust""",
    "books": """
        SELECT k, segment, idn AS true_idn, good, body, bday, c_name,
               lpad(CAST(k AS VARCHAR), 9, '0') AS household_id,
               c_name AS householder_name,
               segment || ' 8' AS address,
               CASE WHEN k % 7 <> 5 THEN 'M' || k END AS member_name,
               ['之子','之女','邻居','配偶'][k % 4 + 1] AS relation_to_head,
               ['女','男','未知'][(k // 3) % 3 + 1] AS gender,
               CASE WHEN k % 4 = 1 OR (k % 5 <> 2 AND k % 11 <> 4) THEN strftime(bday, '%Y-%m-%d') END AS birth_date,
               CASE WHEN k % 5 <> 2 THEN idn END AS id_number, idn
        FROM ids""",
    "book_issues": f"""
        SELECT k, segment, {codes(
            ("gender = '未知'", "invalid_gender", "warning", "gender"),
            ("relation_to_head = '邻居'", "invalid_relation_to_head", "warning", "relation_to_head"),
            *[(f"id_number IS NOT NULL AND {c}", code, s, f) for c, code, s, f in ID_CODES],
            ("id_number IS NOT NULL AND k % 4 = 1 AND k % 11 = 4", "birth_date_mismatch", "warning", "birth_date"),
            ("id_number IS NULL AND birth_date IS NOT NULL", "missing_id_number", "warning", "id_number"),
        )} AS issues
        FROM books""",
    "recs": """
        SELECT p_partkey AS k, '市第' || p_partkey || '医院' AS hospital_name,
               CASE WHEN p_partkey % 9 <> 1 THEN p_name END AS patient_name,
               ['女','男','男','女'][p_partkey % 4 + 1] AS gender,
               CAST(p_partkey % 90 AS VARCHAR) AS age,
               CASE WHEN p_partkey % 4 <> 2 OR p_partkey % 8 = 2
                    THEN strftime(DATE '2024-01-01' + CAST(p_partkey % 700 AS INTEGER), '%Y-%m-%d') END AS visit_date,
               p_type AS department, [p_name, p_type] AS diagnosis,
               CASE WHEN p_partkey % 6 <> 3 THEN [p_brand, 'size ' || p_size] ELSE [] END AS medications,
               'price ' || p_size AS notes
        FROM part""",
    "rec_issues": "SELECT k, " + codes(
        ("patient_name IS NULL", "missing_patient_name", "error", "patient_name"),
        ("visit_date IS NULL", "missing_visit_date", "warning", "visit_date"),
    ) + " AS issues FROM recs",
    "boards": f"""
        SELECT o_orderkey AS k,
               CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 2 = 1 THEN {NAMES}[(o_orderkey + 1) % 5 + 1]
                    ELSE {NAMES}[o_orderkey % 5 + 1] END AS passenger_name,
               'MU' || (1000 + o_orderkey % 9000) AS flight_number,
               CASE WHEN o_orderkey % 8 <> 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '0') || '/1' END AS ticket_number,
               CASE WHEN o_orderkey % 10 <> 7 THEN strftime(o_orderdate, '%d')
                    || ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][month(o_orderdate)] END AS departure_date,
               {CITIES}[o_orderkey % 6 + 1] AS departure_airport,
               CASE WHEN (o_orderkey // 6) % 6 <> 0
                    THEN {CITIES}[(o_orderkey + (o_orderkey // 6) % 6) % 6 + 1] END AS arrival_airport,
               'G' || (o_orderkey % 100) AS gate
        FROM orders""",
    "board_issues": "SELECT k, " + codes(
        ("ticket_number IS NULL", "missing_ticket_number", "error", "ticket_number"),
        ("departure_date IS NULL", "missing_departure_date", "error", "departure_date"),
        ("arrival_airport IS NULL", "missing_arrival_airport", "error", "arrival_airport"),
    ) + " AS issues FROM boards",
    "trains": f"""
        SELECT o_orderkey AS k,
               CASE WHEN o_orderkey % 8 <> 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '0') END AS ticket_number,
               CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 2 = 1 THEN {NAMES}[(o_orderkey + 1) % 5 + 1]
                    ELSE {NAMES}[o_orderkey % 5 + 1] END AS passenger_name,
               CASE WHEN o_orderkey % 2 = 0 THEN ['G','D','K'][o_orderkey % 3 + 1] || (1 + o_orderkey % 999)
                    ELSE ['Z','T'][o_orderkey % 2 + 1] || (1 + o_orderkey % 99) END AS train_number,
               {STATIONS}[o_orderkey % 7 + 1] AS departure_station,
               {STATIONS}[(o_orderkey + 3) % 7 + 1] AS arrival_station,
               CASE WHEN o_orderkey % 6 = 1 THEN '08:30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS departure_time,
               CASE WHEN o_orderkey % 3 = 0 AND 1 + o_orderkey % 999 <= 99 THEN 'G' || (1 + o_orderkey % 999) END AS gate
        FROM orders""",
    "train_issues": "SELECT k, " + codes(
        ("ticket_number IS NULL", "missing_ticket_number", "error", "ticket_number"),
    ) + " AS issues FROM trains",
    "all_issues": """
        SELECT 'china_id' AS plugin, 'china_id/' || k AS doc_id, issues, 0.0 AS warned, 0.0 AS failed FROM id_issues
        UNION ALL SELECT 'passport', 'passport/' || k, issues, 0.0, 0.0 FROM pass_plain
        UNION ALL SELECT 'hukou_booklet', 'hukou_booklet/' || k, issues, 0.8, 0.0 FROM book_issues
        UNION ALL SELECT 'medical_record', 'medical_record/' || k, issues, 1.0, 0.5 FROM rec_issues
        UNION ALL SELECT 'boarding_pass', 'boarding_pass/' || k, issues, 0.0, 0.0 FROM board_issues
        UNION ALL SELECT 'train_ticket', 'train_ticket/' || k, issues, 0.0, 0.0 FROM train_issues""",
    "judged": """
        SELECT plugin, doc_id, issues, len(issues) AS num_issues,
               len(list_filter(issues, lambda i: i.severity = 'error')) = 0 AS accepted,
               CAST(CASE WHEN len(list_filter(issues, lambda i: i.severity = 'error')) > 0 THEN failed
                    WHEN len(issues) > 0 THEN warned ELSE 1.0 END AS DOUBLE) AS score,
               CASE WHEN len(list_filter(issues, lambda i: i.severity = 'error' AND i.code NOT LIKE '%\\_mismatch' ESCAPE '\\')) > 0 THEN 'reject'
                    WHEN len(list_filter(issues, lambda i: i.code LIKE '%\\_mismatch' ESCAPE '\\')) > 0 THEN 'review'
                    WHEN len(issues) > 0 THEN 'accept_with_warning' ELSE 'accept' END AS decision
        FROM all_issues""",
    "gold": """
        SELECT k AS doc_id, f.field AS field, f.expected AS expected, f.predicted AS predicted,
               f.expected IS NOT DISTINCT FROM f.predicted AS matched
        FROM (SELECT k, unnest([
                {'field': 'member_name', 'expected': 'M' || k, 'predicted': member_name},
                {'field': 'gender', 'expected': ['女','男',NULL][(k // 3) % 3 + 1], 'predicted': gender},
                {'field': 'id_number', 'expected': body || good, 'predicted': id_number},
                {'field': 'birth_date', 'expected': strftime(bday, '%Y-%m-%d'), 'predicted': birth_date},
                {'field': 'spouse', 'expected': NULL, 'predicted': NULL}]) AS f FROM books)""",
    "scored": """
        SELECT doc_id, count(*) AS num_fields, sum(CAST(matched AS INTEGER)) AS num_matched_fields,
               sum(CAST(matched AS INTEGER)) / count(*) AS field_exact_match_rate,
               CASE WHEN bool_and(matched) THEN 'pass' ELSE 'fail' END AS status
        FROM gold GROUP BY doc_id""",
    "book_judged": """
        SELECT k AS doc_id, len(list_filter(issues, lambda i: i.severity = 'error')) = 0 AS accepted,
               CASE WHEN len(list_filter(issues, lambda i: i.severity = 'error')) > 0 THEN 'reject'
                    WHEN len(list_filter(issues, lambda i: i.code = 'birth_date_mismatch')) > 0 THEN 'review'
                    WHEN len(issues) > 0 THEN 'accept_with_warning' ELSE 'accept' END AS decision
        FROM book_issues""",
    "textlines": f"""
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t, {WS})), lambda t: t <> '') AS l
        FROM documents""",
    "rawlines": "SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents",
    "rawscores": """
        SELECT doc_id, source, lang, len(l) AS num_lines,
               list_sum(list_transform(l, lambda t: (length(t) % 50) / 100.0::DOUBLE + 0.5)) / len(l) AS confidence FROM rawlines""",
}
NEEDS = {
    "idb": ["cust"], "idc": ["idb"], "ids": ["idc"], "id_issues": ["ids"], "pass_issues": ["cust"], "pass_plain": ["cust"],
    "books": ["ids"], "book_issues": ["books"], "rec_issues": ["recs"], "board_issues": ["boards"],
    "train_issues": ["trains"],
    "all_issues": ["id_issues", "pass_plain", "book_issues", "rec_issues", "board_issues", "train_issues"],
    "judged": ["all_issues"], "gold": ["books"], "scored": ["gold"], "book_judged": ["book_issues"],
    "rawscores": ["rawlines"],
}


def q(names: str, body: str) -> str:
    """A query over named parts and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    body = body.strip()
    # A body may name further parts of its own.
    return f"WITH {parts},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {parts}\n{body}"


def listed(source: str) -> str:
    return f"""
        SELECT k AS doc_id, CAST(seq AS INTEGER) AS seq, i.code AS code, i.severity AS severity, i.field AS field
        FROM (SELECT k, unnest(range(1, len(issues) + 1)) AS seq, unnest(issues) AS i FROM {source})"""


LABEL_ROWS = """
    SELECT k AS doc_id, f.field AS field, f.value AS value FROM (SELECT k, unnest([
        {'field': 'household_id', 'value': household_id || ' 号'},
        {'field': 'householder_name', 'value': householder_name},
        {'field': 'address', 'value': address},
        {'field': 'member_name', 'value': member_name},
        {'field': 'relation_to_head', 'value': relation_to_head},
        {'field': 'gender', 'value': ['Female','male','未知'][(k // 3) % 3 + 1]},
        {'field': 'birth_date', 'value': CASE WHEN k % 4 = 1 THEN year(bday) || '年' || month(bday) || '月' || day(bday) || '日' END},
        {'field': 'id_number', 'value': lower(id_number)}]) AS f FROM books) WHERE f.value IS NOT NULL"""

ASSETS = """
    SELECT d.doc_id, d.source, d.lang, d.text, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS found
    FROM documents d"""


IMAGES = """
    SELECT page_id AS k, url, CASE WHEN page_id % 2 = 0 THEN 'passport' ELSE 'china_id' END AS plugin,
           CASE WHEN page_id % 10 = 4 THEN 'ValueError: empty content' WHEN page_id % 7 = 3 THEN 'ValueError: unreadable ' || page_id
                WHEN page_id % 7 = 5 THEN 'TypeError: ''int'' object is not iterable' END AS error
    FROM pages"""
RAW_RESULTS = """
    SELECT k, CASE k % 10 WHEN 3 THEN substr(whole, 1, length(whole) - 8) WHEN 6 THEN '{"doc_id":"o' || k || '","confidence":"high"}' ELSE whole END AS raw, text, confidence
    FROM (SELECT o_orderkey AS k, o_orderpriority AS text, (o_orderkey % 5) / 4.0::DOUBLE AS confidence,
                 CASE WHEN o_orderkey % 10 <> 8 THEN '{"doc_id":"o' || o_orderkey || '",' ELSE '{' END || '"plugin":"plain","text":"' || o_orderpriority
                 || '","confidence":' || (o_orderkey % 5) / 4.0::DOUBLE || '}' AS whole FROM orders)"""
MALFORMED = f"""
    SELECT CASE WHEN k % 10 = 6 THEN 'o' || k END AS doc_id, CASE WHEN k % 10 = 8 THEN 'plain' END AS plugin,
           CASE WHEN k % 10 = 8 THEN 'missing_doc_id' ELSE 'malformed_json' END AS error, raw FROM ({RAW_RESULTS}) WHERE k % 10 IN (3, 6, 8)"""

AIRPORT_LIST = "('TAIYUAN','FUZHOU','SHANGHAI','HANGZHOU','BEIJING','GUANGZHOU')"
SHEETS = f"""
    WITH sheet AS (SELECT k, body || good AS fixed, idn, k % 7 < 5 AND k % 11 <> 4 AS good_place, DATE '2024-01-01' + CAST(k % 500 AS INTEGER) AS day,
        list_filter([
            CASE WHEN k % 4 <> 1 THEN {{'n': 'anchored_name', 't': 'Passenger: ' || {NAMES}[k % 5 + 1]}} END, {{'n': 'name', 't': {NAMES}[(k + 1) % 5 + 1] || ' checked in'}},
            CASE WHEN k % 17 <> 9 THEN {{'n': 'anchored_number', 't': 'ID No: ' || lower(idn)}} END, {{'n': 'number', 't': 'no ' || body || good}},
            CASE WHEN k % 3 = 0 THEN {{'n': 'label', 't': 'Date'}} END,
            CASE WHEN k % 3 = 0 THEN {{'n': 'date', 't': year(DATE '2024-01-01' + CAST(k % 500 AS INTEGER)) || '年' || month(DATE '2024-01-01' + CAST(k % 500 AS INTEGER)) || '月' || day(DATE '2024-01-01' + CAST(k % 500 AS INTEGER)) || '日'}} END,
            {{'n': 'printed', 't': CASE WHEN k % 6 = 0 THEN 'printed 2020-02-30' ELSE 'printed 2020/1/9' END}},
            CASE WHEN k % 5 <> 2 THEN {{'n': 'route', 't': {STATIONS}[k % 7 + 1] || ' - ' || {STATIONS}[(k + 3) % 7 + 1]}} END,
            CASE WHEN k % 5 <= 2 THEN {{'n': 'via', 't': 'via ' || {STATIONS}[(k + 1) % 7 + 1] || ' → ' || {STATIONS}[(k + 2) % 7 + 1]}} END],
            lambda x: x IS NOT NULL) AS ls FROM ids),
    told AS (SELECT k, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls).n AS n, fixed, idn, good_place, day FROM sheet),
    hits AS (
        SELECT k, 'name' AS field, {NAMES}[k % 5 + 1] AS value, 0.4 + 0.4 + 0.1 + 0.12 AS score, true AS anchored, true AS valid, line_no FROM told WHERE n = 'anchored_name'
        UNION ALL SELECT k, 'name', {NAMES}[(k + 1) % 5 + 1], 0.4 + CASE WHEN k % 4 <> 1 THEN 0.1::DOUBLE / (1 + 300 / 50.0::DOUBLE) ELSE 0.0 END + 0.18, false, true, line_no FROM told WHERE n = 'name'
        UNION ALL SELECT k, 'number', idn, 0.4 + CASE WHEN good_place AND idn = fixed THEN 0.4 ELSE 0.0 END + 0.1, true, good_place AND idn = fixed, line_no FROM told WHERE n = 'anchored_number'
        UNION ALL SELECT k, 'number', fixed, CASE WHEN good_place THEN 0.4 ELSE 0.0 END + 0.18, false, good_place, line_no FROM told WHERE n = 'number'
        UNION ALL SELECT k, 'date', strftime(day, '%Y-%m-%d'), 0.4 + 0.4 + 0.14, true, true, line_no FROM told WHERE n = 'date'
        UNION ALL SELECT k, 'date', CASE WHEN k % 6 = 0 THEN '2020-02-30' ELSE '2020-01-09' END, CASE WHEN k % 6 = 0 THEN 0.19 ELSE 0.46 END, false, k % 6 <> 0, line_no FROM told WHERE n = 'printed'
        UNION ALL SELECT k, 'route', {STATIONS}[k % 7 + 1] || '-' || {STATIONS}[(k + 3) % 7 + 1], 0.56, false, true, line_no FROM told WHERE n = 'route'
        UNION ALL SELECT k, 'route', {STATIONS}[(k + 1) % 7 + 1] || '-' || {STATIONS}[(k + 2) % 7 + 1], 0.48, false, true, line_no FROM told WHERE n = 'via'),
    best AS (SELECT k, field, value, max(score)::DOUBLE AS score, arg_max(anchored, score) AS anchored, arg_max(valid, score) AS valid, arg_max(line_no, score) AS line_no FROM hits GROUP BY k, field, value),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY score DESC, value DESC) AS rank FROM best)
"""
TWO_FAMILIES = """
    WITH p AS (SELECT 'p/' || k AS doc_id, 'passport' AS plugin, k, unnest([
            {'f': 'mrz_lines', 'm': CAST(k % 9 = 4 OR k % 6 NOT IN (1, 2) AS INTEGER), 'g': 1},
            {'f': 'passport_number', 'm': CAST(k % 9 <> 4 AS INTEGER), 'g': CAST(k % 9 <> 4 AS INTEGER)}, {'f': 'surname', 'm': CAST(k % 9 <> 4 AS INTEGER), 'g': CAST(k % 9 <> 4 AS INTEGER)}]) AS x FROM cust),
    b AS (SELECT 'b/' || k AS doc_id, 'hukou_booklet' AS plugin, k, unnest([
            {'f': 'member_name', 'm': CAST(member_name IS NOT NULL AS INTEGER), 'g': CAST(member_name IS NOT NULL AS INTEGER)},
            {'f': 'birth_date', 'm': CAST(birth_date IS NOT NULL AS INTEGER), 'g': CAST(birth_date IS NOT NULL AS INTEGER)}]) AS x FROM books),
    judged AS (SELECT 'b/' || doc_id AS doc_id, accepted, decision FROM book_judged
        UNION ALL SELECT 'p/' || k, k % 9 <> 4 AND k % 6 NOT IN (1, 2), CASE WHEN k % 9 <> 4 AND k % 6 NOT IN (1, 2) THEN 'accept' ELSE 'reject' END FROM cust),
    fields AS (SELECT doc_id, plugin, x.f AS field, x.m AS m, x.g AS given FROM p UNION ALL SELECT doc_id, plugin, x.f, x.m, x.g FROM b),
    pairs AS (SELECT f.*, accepted, decision, min(m) OVER (PARTITION BY doc_id) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY field) = 1 AS first
             FROM fields f JOIN judged USING (doc_id))
"""

UNROUTED = "'plain/' || doc_id AS doc_id, 'plain' AS plugin"


def oracle_sql() -> dict[str, str]:
    return {
        "ocr_lines": q("textlines", """
            SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line_no, unnest(l) AS text FROM textlines"""),
        "line_profile": q("rawscores", """
            SELECT r.doc_id, CAST(num_lines AS INTEGER) AS num_lines, round(confidence, 9) AS confidence, substr(text, 1, 120) AS preview
            FROM rawscores r JOIN documents d ON r.doc_id = d.doc_id"""),
        "payload_lines": """
            WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_type, CAST('0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DOUBLE) AS s FROM part)
            SELECT k AS doc_id, 1 AS line_no, p_name AS text, s AS score, 9.0::DOUBLE AS right_edge FROM p
            UNION ALL SELECT k, 2, p_brand, 0.0, NULL FROM p
            UNION ALL SELECT k, 3, p_type, 0.0, NULL FROM p WHERE k % 2 = 0""",
        "payload_documents": """
            SELECT p_partkey AS doc_id, p_name || chr(10) || p_brand || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || p_type ELSE '' END AS text,
                   round(CAST('0.' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DOUBLE) / CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END, 9) AS confidence,
                   true AS payload_ok
            FROM part""",
        "layout_fields": f"""
            WITH c AS (SELECT *, trim(text, {WS}) AS t FROM conversations)
            SELECT conv_id, turn, trim(role || chr(10) || t || chr(10) || t || chr(10) || role || chr(10) || t, {WS}) AS text,
                   role AS kv_key, text AS kv_value, 1 AS num_entries, (turn % 4) * 0.25::DOUBLE AS confidence, true AS complete
            FROM c""",
        "manifest_samples": """
            SELECT 'doc-' || doc_id AS sample_id, lang AS doc_type, 'docs/' || doc_id || '.png' AS image_path,
                   source AS tag, 'set' AS name, '0.1.0' AS version
            FROM documents WHERE doc_id % 10 <> 3""",
        "manifest_errors": """
            SELECT 'doc-' || doc_id AS sample_id, 'image_path' AS missing_keys FROM documents WHERE doc_id % 10 = 3""",
        "asset_facts": f"""
            SELECT doc_id AS sample_id, CASE WHEN found THEN strlen(text) END AS size_bytes,
                   CASE WHEN found THEN sha256(text) END AS sha256, CASE WHEN NOT found THEN 'missing_file' END AS error
            FROM ({ASSETS})""",
        "missing_assets": f"SELECT doc_id AS sample_id, 'docs/' || doc_id || '.txt' AS path, 'missing_file' AS error FROM ({ASSETS}) WHERE NOT found",
        "asset_summary": q("rawscores", """
            SELECT CASE WHEN grouping(source) = 1 THEN 'kind' ELSE 'category' END AS grouped_by,
                   CASE WHEN grouping(source) = 1 THEN lang ELSE source END AS name, count(*) AS count,
                   round(avg(confidence), 4) AS avg_confidence, round(avg(num_lines), 2) AS avg_num_lines,
                   round(min(confidence), 4) AS min_confidence, round(max(confidence), 4) AS max_confidence
            FROM rawscores WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY GROUPING SETS ((source), (lang))"""),
        "asset_totals": f"""
            SELECT count(*) AS num_samples, CAST(sum(CAST(found AS INTEGER)) AS BIGINT) AS num_processed,
                   count(*) - CAST(sum(CAST(found AS INTEGER)) AS BIGINT) AS num_errors,
                   CASE WHEN bool_and(found) THEN 'pass' ELSE 'fail' END AS status FROM ({ASSETS})""",
        "golden_rows": """
            SELECT k AS doc_id, f.field AS field, f.expected AS expected FROM (SELECT c_custkey AS k, unnest([
                {'field': 'name', 'expected': c_name},
                {'field': 'none', 'expected': NULL},
                {'field': 'tags', 'expected': '["a","' || c_mktsegment || '"]'}]) AS f FROM customer)""",
        "label_studio_rows": "SELECT 'label_studio' AS source, conv_id, turn, role AS raw_role FROM conversations",
        "intake_verdicts": """
            WITH u AS (SELECT page_id, ['china_id','passport','driver_licence',NULL][page_id % 4 + 1] AS plugin, page_id % 5 = 0 AS emptied FROM pages)
            SELECT page_id, CASE WHEN plugin IS NULL THEN 422 WHEN plugin = 'driver_licence' THEN 404 WHEN emptied THEN 400 ELSE 200 END AS status,
                   CASE WHEN plugin IS NULL THEN 'missing_plugin' WHEN plugin = 'driver_licence' THEN 'unknown_plugin' WHEN emptied THEN 'empty_file' END AS reason
            FROM u""",
        "annotation_fields": q("rawlines", """
            SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'ocr_line_' || n AS field_name, 'r' || n AS region_id, t AS value,
                   round((length(t) % 50) / 100.0::DOUBLE + 0.5, 9) AS confidence
            FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS t FROM rawlines)"""),
        "date_texts": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
        "file_stems": """
            SELECT page_id, CASE WHEN page_id % 9 = 8 THEN 'in_memory_sample' ELSE 'scan.' || page_id END AS sample_id FROM pages""",

        "id_card_fields": q("ids", """
            SELECT k AS doc_id, 'front' AS document_side, CASE WHEN k % 13 <> 6 THEN replace(c_name, ' ', '') END AS name,
                   ['女','男'][k % 2 + 1] AS gender, '汉' AS ethnicity, strftime(bday, '%Y年%m月%d日') AS birth_date,
                   replace(segment, ' ', '') || 'No' || nation AS address,
                   CASE WHEN k % 17 <> 9 THEN idn END AS id_number
            FROM ids"""),
        "id_back_fields": """
            WITH s AS (SELECT s_suppkey AS k, s_name, DATE '2001-01-01' + CAST(s_suppkey % 5000 AS INTEGER) AS d FROM supplier)
            SELECT k AS doc_id, 'back' AS document_side, replace(s_name, ' ', '') AS issuing_authority,
                   [strftime(d, '%Y.%m.%d'), strftime(d, '%Y%m%d'), strftime(d, '%Y')][k % 3 + 1] AS valid_from, ['2030.01.01','长期','2031'][k % 3 + 1] AS valid_to
            FROM s""",
        "id_number_issues": q("id_issues", listed("id_issues")),
        "id_decisions": q("id_issues", """
            SELECT segment, count(*) AS num_documents, count(*) FILTER (WHERE len(issues) = 0) AS num_accepted,
                   count(*) FILTER (WHERE len(list_filter(issues, lambda i: i.code = 'checksum_invalid')) > 0) AS num_bad_checksums
            FROM id_issues GROUP BY segment"""),
        "passport_fields": q("cust", """
            SELECT k AS doc_id, s.* FROM (SELECT k, CASE WHEN k % 9 <> 4 THEN {
                'document_code': 'P<', 'issuing_country': 'N' || translate(lpad(CAST(nation AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ'),
                'surname': 'CUSTOMER', 'given_names': segment, 'passport_number': 'C' || lpad(CAST(k AS VARCHAR), 7, '0'),
                'nationality': 'N' || translate(lpad(CAST(nation AS VARCHAR), 2, '0'), '0123456789', 'ABCDEFGHIJ'),
                'birth_date': strftime(bday, '%Y-%m-%d'), 'sex': ['F','M',NULL][k % 3 + 1],
                'expiry_date': strftime(DATE '2020-01-01' + CAST(k % 4000 AS INTEGER), '%Y-%m-%d'),
                'personal_number': 'ZE' || lpad(CAST(k AS VARCHAR), 9, '0')} END AS s FROM cust)"""),
        "passport_issues": q("pass_issues", listed("pass_issues")),
        "booklet_fields": q("books", """
            SELECT k AS doc_id, household_id, householder_name, address, member_name, relation_to_head, gender, birth_date, id_number FROM books"""),
        "booklet_issues": q("book_issues", listed("book_issues")),
        "booklet_scores": q("judged", """
            SELECT score, accepted, count(*) AS num_documents FROM judged WHERE plugin = 'hukou_booklet' GROUP BY score, accepted"""),
        "record_fields": q("recs", """
            SELECT k AS doc_id, hospital_name, patient_name, gender, age, visit_date, department, notes,
                   array_to_string(diagnosis, '|') AS diagnosis, array_to_string(medications, '|') AS medications FROM recs"""),
        "record_items": q("recs", """
            SELECT k AS doc_id, 'diagnosis' AS kind, unnest(diagnosis) AS item FROM recs
            UNION ALL SELECT k, 'medication', unnest(medications) FROM recs"""),
        "record_issues": q("rec_issues", listed("rec_issues")),
        "boarding_fields": q("boards", "SELECT k AS doc_id, * EXCLUDE (k) FROM boards"),
        "boarding_issues": q("board_issues", listed("board_issues")),
        "train_fields": q("trains", "SELECT k AS doc_id, 'train_ticket' AS document_variant, * EXCLUDE (k) FROM trains"),
        "train_issues": q("train_issues", listed("train_issues")),
        "label_values": q("books", LABEL_ROWS),
        "label_values_of_lines": q("books", LABEL_ROWS),
        "place_routes": q("boards", "SELECT k AS doc_id, departure_airport AS departure, arrival_airport AS arrival FROM boards"),
        "nearest_candidates": """
            WITH c AS (SELECT l_orderkey AS doc_id, 'P' || l_partkey || '/' || l_linenumber AS text, l_discount AS score, l_quantity AS x, l_tax AS y FROM lineitem),
            a AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 50 AS DOUBLE) AS ax FROM orders WHERE o_orderkey % 10 <> 3),
            r AS (SELECT c.doc_id, c.text, coalesce(abs((x + (x + 2)) / 2 - (ax + (ax + 2)) / 2) + abs((y + (y + 1)) / 2 - 0.5), 1e9) AS distance, score
                  FROM c LEFT JOIN a ON c.doc_id = a.doc_id)
            SELECT doc_id, text, round(distance, 9) AS distance
            FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, -score, text) AS rn FROM r) WHERE rn = 1""",
        "merged_fields": """
            WITH p AS (SELECT o_orderkey AS doc_id, 'status' AS field, o_orderstatus AS value FROM orders
                       UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders),
            g AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'status' ELSE 'extra' END AS field,
                         CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS value, true AS given FROM customer)
            SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, coalesce(p.field, g.field) AS field,
                   CASE WHEN g.given THEN g.value ELSE p.value END AS value, coalesce(g.given, false) AS provided
            FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.field = g.field""",
        "field_outcomes": q("gold", "SELECT doc_id, field, expected, predicted, matched FROM gold"),
        "document_scores": q("scored", """
            SELECT doc_id, CAST(num_fields AS INTEGER) AS num_fields, CAST(num_matched_fields AS INTEGER) AS num_matched_fields,
                   field_exact_match_rate, status FROM scored"""),
        "evaluation_totals": q("scored", """
            SELECT count(*) AS num_fixtures, count(*) FILTER (WHERE status = 'pass') AS num_passed,
                   count(*) FILTER (WHERE status = 'fail') AS num_failed, CAST(sum(num_fields) AS BIGINT) AS num_fields,
                   CAST(sum(num_matched_fields) AS BIGINT) AS num_matched_fields,
                   round(sum(num_matched_fields) / sum(num_fields), 9) AS overall_field_exact_match_rate,
                   CASE WHEN count(*) FILTER (WHERE status = 'fail') = 0 THEN 'pass' ELSE 'fail' END AS status FROM scored"""),
        "evaluation_report": q("scored book_judged", """
            SELECT 'hukou_booklet' AS plugin, g.field AS field,
                   round(avg(CAST(matched AS INTEGER)), 9) AS exact_match,
                   round(2.0 * count(*) FILTER (WHERE matched AND expected IS NOT NULL) / nullif(count(expected) + count(predicted), 0), 9) AS f1,
                   count(*) AS support,
                   CASE WHEN grouping(g.field) = 1 THEN (SELECT round(avg(CASE WHEN status = 'pass' THEN 1 ELSE 0 END), 9) FROM scored) END AS document_success_rate,
                   CASE WHEN grouping(g.field) = 1 THEN (SELECT round(avg(CASE WHEN accepted THEN 0 ELSE 1 END), 9) FROM book_judged) END AS review_rate
            FROM gold g GROUP BY ROLLUP (g.field)"""),
        "quality_metrics": q("scored book_judged", """
            SELECT 'hukou_booklet' AS plugin, (SELECT count(*) FROM scored) AS num_documents,
                   (SELECT round(avg(CAST(matched AS INTEGER)), 9) FROM gold) AS field_exact_match,
                   (SELECT round(avg(CAST(matched AS INTEGER)), 9) FROM gold WHERE field = 'id_number') AS critical_field_exact_match,
                   (SELECT round(avg(CAST(matched AS INTEGER)), 9) FROM gold WHERE field = 'birth_date') AS date_exact_match,
                   (SELECT round(avg(CAST(matched AS INTEGER)), 9) FROM gold WHERE field = 'id_number') AS number_exact_match,
                   (SELECT round(avg(CASE WHEN status = 'pass' THEN 1 ELSE 0 END), 9) FROM scored) AS document_success_rate,
                   (SELECT round(avg(CASE WHEN decision = 'review' THEN 1 ELSE 0 END), 9) FROM book_judged) AS review_rate,
                   (SELECT round(count(*) FILTER (WHERE accepted AND status <> 'pass') / nullif(count(*) FILTER (WHERE accepted), 0), 9)
                    FROM scored s JOIN book_judged b ON s.doc_id = b.doc_id) AS false_accept_rate"""),
        "dataset_summary": """
            SELECT count(*) AS num_samples, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT coalesce(CASE WHEN doc_id % 9 <> 0 THEN lang END, 'unknown') AS t FROM documents)) AS doc_types
            FROM documents""",
        "positional_split": """
            SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split
            FROM documents""",
        "positional_split_events": """
            SELECT split, count(*) AS num_events, min(ts) AS first_ts, max(ts) AS last_ts FROM (
                SELECT ts, CASE WHEN row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.7) THEN 'train' ELSE 'val' END AS split FROM events)
            GROUP BY split""",
        "positional_split_ties": """
            SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY CASE WHEN doc_id % 9 <> 0 THEN lang END NULLS FIRST, doc_id) <= floor(count(*) OVER () * 0.6)
                   THEN 'train' ELSE 'val' END AS split FROM documents""",
        "hash_split": """
            SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'val' END AS split
            FROM documents""",
        "dataset_layers": """
            SELECT doc_id, CASE WHEN doc_id % 20 = 7 THEN 'golden' WHEN quality = 0 OR toxic = 1 THEN 'hard'
                   WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'val' END AS layer
            FROM labels""",
        "malformed_manifests": """
            SELECT doc_id, ['not_json', 'no_samples', 'empty_samples'][doc_id % 4 + 1] AS error FROM documents WHERE doc_id % 4 < 3""",
        "label_values_of_foreign_lines": q("books", LABEL_ROWS),
        "unrecognised_assets": f"""
            SELECT doc_id AS sample_id, CASE WHEN found THEN 'not_recognised' ELSE 'missing_file' END AS error FROM ({ASSETS}) WHERE NOT found OR doc_id % 5 = 0""",
        "kept_overrides": "SELECT c_custkey AS doc_id, c_mktsegment AS segment, false AS was_read FROM customer",
        "rejected_unrouted": q("textlines", """
            SELECT 'plain/' || doc_id AS doc_id, 'unknown_plugin' AS reason, 'unknown plugin' AS message, CAST(len(l) AS INTEGER) AS num_lines FROM textlines"""),
        "hard_share": """
            WITH s AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'val' END AS split FROM labels)
            SELECT split, count(*) AS num_samples, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS num_hard,
                   count(*) FILTER (WHERE quality = 0 OR toxic = 1) >= count(*) * 0.2 AS enough_hard
            FROM s JOIN labels USING (doc_id) GROUP BY split""",
        "processed_documents": q("judged", "SELECT doc_id, plugin, accepted, score, CAST(num_issues AS INTEGER) AS num_issues, decision FROM judged"),
        "unroutable_documents": "SELECT 'plain' AS plugin, count(*) AS num_documents FROM documents",
        "dead_letters": q("judged", """
            SELECT doc_id, plugin, split_part(doc_id, '/', 2) AS sample_id, CAST(num_issues AS INTEGER) AS num_issues, score FROM judged WHERE NOT accepted"""),
        "failures_by_cause": q("all_issues", """
            SELECT plugin, CASE WHEN code = 'missing_mrz_lines' THEN 'ocr_error' WHEN code LIKE 'missing%' THEN 'parser_error'
                   WHEN code LIKE '%check_failed' OR code = 'checksum_invalid' THEN 'ocr_error' WHEN code LIKE 'invalid%' THEN 'schema_error'
                   WHEN code LIKE '%mismatch' THEN 'validator_error' ELSE 'ocr_error' END AS root_cause, code, count(*) AS num_issues
            FROM (SELECT plugin, unnest(issues).code AS code FROM all_issues) GROUP BY ALL"""),
        "top_failures": q("all_issues", """
            SELECT period, plugin, code, num_issues, CAST(rank AS INTEGER) AS rank FROM (
                SELECT *, row_number() OVER (PARTITION BY period ORDER BY num_issues DESC, plugin, code) AS rank FROM (
                    SELECT period, plugin, code, count(*) AS num_issues FROM (
                        SELECT 'week ' || (CAST(split_part(doc_id, '/', 2) AS BIGINT) % 4) AS period, plugin, unnest(issues).code AS code FROM all_issues)
                    GROUP BY ALL)) WHERE rank <= 5"""),
        "decisions": q("judged", "SELECT plugin, decision, count(*) AS num_documents FROM judged GROUP BY plugin, decision"),
        "review_queue": q("cust", """
            SELECT k AS doc_id, CASE WHEN k % 3 = 2 THEN 12 ELSE 13 END AS num_fields, 1 AS num_errors
            FROM cust WHERE k % 8 = 3 AND k % 9 <> 4 AND k % 6 NOT IN (1, 2)"""),
        "number_candidates": q("ids", """
            WITH c AS (SELECT k, idn, body || good AS fixed FROM ids)
            SELECT k AS doc_id, f.value AS value, f.labelled AS labelled, round(f.score, 9) AS score FROM (
                SELECT k, unnest([
                    {'value': CASE WHEN k % 17 <> 9 THEN idn END, 'labelled': true, 'score': CAST(0.4 + valid + 0.1 AS DOUBLE)},
                    {'value': CASE WHEN k % 17 <> 9 THEN idn END, 'labelled': false, 'score': CAST(valid + 0.1 AS DOUBLE)},
                    {'value': fixed, 'labelled': false, 'score': CAST(valid_fixed + 0.18 AS DOUBLE)}]) AS f
                FROM (SELECT k, idn, fixed,
                        CASE WHEN good_place AND idn = fixed THEN 0.4 ELSE 0.0 END AS valid, CASE WHEN good_place THEN 0.4 ELSE 0.0 END AS valid_fixed
                      FROM (SELECT *, k % 7 < 5 AND k % 11 <> 4 AS good_place FROM c)))
            WHERE f.value IS NOT NULL"""),
        "chosen_numbers": q("ids", """
            SELECT k AS doc_id, CASE WHEN k % 17 = 9 THEN body || good
                   WHEN idn <> body || good AND k % 7 < 5 AND k % 11 <> 4 THEN CASE WHEN 0.5 >= 0.58 THEN idn ELSE body || good END
                   ELSE idn END AS chosen FROM ids"""),
        "completeness": q("books recs boards trains", """
            WITH f AS (
                SELECT 'hukou_booklet' AS plugin, unnest([{'f': 'household_id', 'v': household_id}, {'f': 'householder_name', 'v': householder_name},
                    {'f': 'address', 'v': address}, {'f': 'member_name', 'v': member_name}, {'f': 'relation_to_head', 'v': relation_to_head},
                    {'f': 'gender', 'v': gender}, {'f': 'birth_date', 'v': birth_date}, {'f': 'id_number', 'v': id_number}]) AS x FROM books
                UNION ALL SELECT 'medical_record', unnest([{'f': 'hospital_name', 'v': hospital_name}, {'f': 'patient_name', 'v': patient_name},
                    {'f': 'gender', 'v': gender}, {'f': 'age', 'v': age}, {'f': 'visit_date', 'v': visit_date}, {'f': 'department', 'v': department},
                    {'f': 'diagnosis', 'v': 'd'}, {'f': 'medications', 'v': CASE WHEN len(medications) > 0 THEN 'm' END}, {'f': 'notes', 'v': notes}]) FROM recs
                UNION ALL SELECT 'boarding_pass', unnest([{'f': 'passenger_name', 'v': passenger_name}, {'f': 'flight_number', 'v': flight_number},
                    {'f': 'ticket_number', 'v': ticket_number}, {'f': 'departure_date', 'v': departure_date}, {'f': 'departure_airport', 'v': departure_airport},
                    {'f': 'arrival_airport', 'v': arrival_airport}, {'f': 'gate', 'v': gate}, {'f': 'seat_no', 'v': NULL}]) FROM boards
                UNION ALL SELECT 'train_ticket', unnest([{'f': 'ticket_number', 'v': ticket_number}, {'f': 'passenger_name', 'v': passenger_name},
                    {'f': 'id_number', 'v': NULL}, {'f': 'train_number', 'v': train_number}, {'f': 'departure_station', 'v': departure_station},
                    {'f': 'arrival_station', 'v': arrival_station}, {'f': 'departure_time', 'v': departure_time}, {'f': 'seat_no', 'v': NULL}, {'f': 'fare', 'v': NULL}]) FROM trains)
            SELECT plugin, x.f AS field, count(*) AS num_documents, count(x.v) AS num_present, round(1 - count(x.v) / count(*), 9) AS missing_rate
            FROM f GROUP BY ALL"""),
        "quality_routes": """
            WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS blur, l_tax * 10 AS glare, CAST(l_quantity AS DOUBLE) / 50 AS shadow,
                       ['boarding_pass','hukou_booklet','passport'][l_linenumber % 3 + 1] AS plugin FROM lineitem),
            d AS (SELECT *, [blur, glare] || CASE WHEN plugin = 'boarding_pass' THEN [] ELSE [shadow] END AS ds FROM s)
            SELECT plugin, CASE WHEN list_max(ds) >= 0.8 THEN 'review' WHEN list_max(ds) >= 0.5 THEN 'enhanced' ELSE 'normal' END AS route,
                   list_max(ds) < 0.5 AS passed, count(*) AS num_images, CAST(sum(len(list_filter(ds, lambda v: v >= 0.5))) AS BIGINT) AS num_reasons
            FROM d GROUP BY ALL""",
        "card_pairs": q("ids", """
            SELECT coalesce(f.case_id, b.case_id) AS case_id, f.front_id, b.back_id, coalesce(f.n, 0) AS num_fronts, coalesce(b.n, 0) AS num_backs,
                   concat_ws('|', CASE WHEN f.n IS NULL THEN 'missing_front' END, CASE WHEN b.n IS NULL THEN 'missing_back' END,
                             CASE WHEN f.n > 1 THEN 'repeated_front' END, CASE WHEN b.n > 1 THEN 'repeated_back' END) AS warnings
            FROM (SELECT k % 400 AS case_id, min(k) AS front_id, count(*) AS n FROM ids GROUP BY 1) f
            FULL JOIN (SELECT s_suppkey * 5 AS case_id, min(s_suppkey) AS back_id, count(*) AS n FROM supplier GROUP BY 1) b ON f.case_id = b.case_id"""),
        "source_selection": """
            WITH r AS (SELECT o_custkey AS doc_id, o_orderstatus AS field, o_orderkey || '' AS value, (o_orderkey % 1000) / 1000.0::DOUBLE AS confidence,
                       o_orderkey % 5 + 1 AS rank, ['vlm_fallback','barcode','template_ocr','mrz','manual'][o_orderkey % 5 + 1] AS source FROM orders)
            SELECT doc_id, field, value, source, round(confidence, 9) AS confidence, round(m, 9) AS mean_confidence, n AS num_results FROM (
                SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rank DESC, confidence DESC, value DESC) AS rn,
                       avg(confidence) OVER (PARTITION BY doc_id, field) AS m, count(*) OVER (PARTITION BY doc_id, field) AS n FROM r) WHERE rn = 1""",
        "tagged_annotations": """
            SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_returnflag AS tag, max(l_discount) AS score
            FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL""",
        "relation_texts": """
            SELECT o_orderkey || '' AS sample_id, 'r1' AS from_id, 'r2' AS to_id, 'label_of' AS relation_type, o_orderpriority AS from_text, o_orderstatus AS to_text FROM orders""",
        "unknown_sources": "SELECT role AS source, count(*) AS num_rows FROM conversations GROUP BY role",
        "decision_rates": """
            SELECT date_trunc('hour', ts) AS window_start, event_type AS plugin, count(*) AS num_documents,
                   count(*) FILTER (WHERE value >= 10) AS num_accepted, count(*) FILTER (WHERE value < 10 AND value >= 5) AS num_review
            FROM events GROUP BY ALL""",
        "first_uploads": """
            SELECT user_id AS sample_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
        "live_rates": """
            SELECT date_trunc('hour', ts) AS window_start, event_type AS plugin, count(*) AS num_documents,
                   count(*) FILTER (WHERE value >= 10) AS num_accepted, count(*) FILTER (WHERE value < 10 AND value >= 5) AS num_review
            FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
        "live_uploads": "SELECT DISTINCT user_id AS sample_id FROM events",
        "live_decisions": q("judged", f"""
            SELECT doc_id, plugin, accepted, score, CAST(num_issues AS INTEGER) AS num_issues FROM judged
            UNION ALL SELECT {UNROUTED}, false, 0.0::DOUBLE, 1 FROM documents"""),
        "live_dead_letters": q("judged", f"""
            SELECT doc_id, plugin, CAST(num_issues AS INTEGER) AS num_issues FROM judged WHERE NOT accepted
            UNION ALL SELECT {UNROUTED}, 1 FROM documents"""),
        "layout_trees": f"""
            WITH c AS (SELECT conv_id, turn, role, trim(text, {WS}) AS t, (turn % 4) * 0.25::DOUBLE AS s, turn % 11 <> 10 AS ok FROM conversations),
            d AS (SELECT *, trim(role || chr(10) || repeat(CASE WHEN t = '' THEN '' ELSE t || chr(10) END, 2) || 'block' || chr(10) || 'again' || chr(10) || 'again' || chr(10) || 'who', {WS}) AS whole,
                    CASE WHEN ok THEN unnest(CASE WHEN ok THEN [1, 2] ELSE [0] END) END AS e FROM c)
            SELECT conv_id, turn, CASE WHEN ok THEN whole ELSE '' END AS document_text, CASE WHEN ok THEN '{{"who":"{{\\"is\\":[' || conv_id || ']}}"}}' ELSE '{{}}' END AS pairs,
                   CASE WHEN ok THEN (s + 0.5) / 2 ELSE 0.0 END AS confidence, ok AS complete, CAST(e - 1 AS INTEGER) AS entry_no,
                   CASE e WHEN 1 THEN t WHEN 2 THEN 'again' END AS text, CASE e WHEN 1 THEN s WHEN 2 THEN 0.5 END AS score,
                   CASE e WHEN 1 THEN '[0,' || turn || ']' END AS bbox, CASE e WHEN 2 THEN '[1,' || turn || ']' END AS box, CASE e WHEN 1 THEN 'block' END AS type
            FROM d""",
        "engine_results": f"""
            SELECT '' || k AS doc_id, plugin, 'reader' AS engine, url AS text,
                   '[{{"text":"' || k || '","score":0.25}},{{"text":"' || url || '"}}]' AS lines, (k % 5) / 4.0::DOUBLE AS confidence
            FROM ({IMAGES}) WHERE error IS NULL""",
        "engine_letters": f"SELECT '' || k AS doc_id, 'reader' AS engine, error, 'r1' AS run_id, plugin FROM ({IMAGES}) WHERE error IS NOT NULL",
        "engine_layouts": f"""
            SELECT '' || k AS doc_id, CASE WHEN e IS NULL THEN url || chr(10) || url || chr(10) || 'no ' || k || chr(10) || 'no ' || k ELSE '' END AS text,
                   CASE WHEN e IS NULL THEN 2 ELSE 0 END AS num_entries, CASE WHEN e IS NULL THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence, e IS NULL AS complete, e AS error
            FROM (SELECT *, CASE WHEN error NOT LIKE 'TypeError%' THEN error END AS e FROM ({IMAGES}))""",
        "wellformed_results": f"SELECT 'o' || k AS doc_id, 'plain' AS plugin, text, confidence FROM ({RAW_RESULTS}) WHERE k % 10 NOT IN (3, 6, 8)",
        "malformed_results": MALFORMED,
        "live_malformed": MALFORMED,
        "live_intake": """
            WITH u AS (SELECT page_id, ['china_id','passport','driver_licence',NULL][page_id % 4 + 1] AS plugin, CASE WHEN page_id % 5 = 0 THEN '' ELSE html END AS content FROM pages),
            v AS (SELECT *, CASE WHEN plugin IS NULL THEN 422 WHEN plugin = 'driver_licence' THEN 404 WHEN content = '' THEN 400 ELSE 200 END AS status FROM u)
            SELECT page_id, plugin, status, CASE status WHEN 422 THEN 'missing_plugin' WHEN 404 THEN 'unknown_plugin' WHEN 400 THEN 'empty_file' END AS reason,
                   strlen(content) AS size_bytes, CASE WHEN status = 200 THEN sha256(content) END AS sha256 FROM v""",
        "live_latest_uploads": """
            SELECT user_id AS sample_id, ts, event_id, event_type, value FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC, value DESC) AS rn FROM events) WHERE rn = 1""",
        "working_set": """
            WITH l AS (SELECT doc_id, coalesce(quality = 0 OR toxic = 1, false) AS hard, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM labels),
            n AS (SELECT count(*) // 2 AS size, count(*) FILTER (WHERE hard) AS nh, count(*) FILTER (WHERE NOT hard) AS ne FROM l),
            q AS (SELECT *, least(nh, greatest(CAST(ceil(size * 0.2) AS BIGINT), size - ne)) AS th FROM n),
            r AS (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY h) AS rn FROM l)
            SELECT doc_id, hard FROM r, q WHERE rn <= CASE WHEN hard THEN th ELSE least(ne, size - th, th * 4) END""",
        "field_candidates": q("ids", SHEETS + """
            SELECT k AS doc_id, field, value, round(score, 9) AS score, anchored, valid, CAST(line_no AS INTEGER) AS line_no, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""),
        "chosen_fields": q("ids", SHEETS + """
            SELECT k AS doc_id, field, value, round(score, 9) AS score, round(score - next, 9) AS lead
            FROM (SELECT *, lead(score) OVER (PARTITION BY k, field ORDER BY rank) AS next FROM ranked) WHERE rank = 1"""),
        "review_candidates": q("ids", SHEETS + """
            SELECT k AS doc_id, best, 'unknown_plugin' AS errors, array_to_string(list_filter(list_transform(ls, lambda x: x.t), lambda t: t IS NOT NULL), '|') AS lines
            FROM sheet JOIN (SELECT k, string_agg(field || '=' || value, '; ' ORDER BY field) AS best FROM ranked WHERE rank = 1 GROUP BY k) USING (k)"""),
        "review_evidence": q("cust", """
            WITH queue AS (SELECT k, segment, 1 + CAST(k % 4 = 0 AS INTEGER) + 1 AS first_line FROM cust WHERE k % 8 = 3 AND k % 9 <> 4 AND k % 6 NOT IN (1, 2))
            SELECT k AS doc_id, f.field AS field, f.value AS value, f.line_nos AS line_nos FROM (SELECT k, unnest([
                {'field': 'passport_number', 'value': 'X' || lpad(CAST(k AS VARCHAR), 7, '0'), 'line_nos': CAST([] AS INTEGER[])},
                {'field': 'surname', 'value': 'CUSTOMER', 'line_nos': CAST([] AS INTEGER[])},
                {'field': 'personal_number', 'value': 'ZE' || lpad(CAST(k AS VARCHAR), 9, '0'), 'line_nos': [first_line + 2]}]) AS f FROM queue)"""),
        "kind_documents": q("pass_plain", """
            SELECT k AS doc_id, kind, CASE kind WHEN 'passport' THEN 1 WHEN 'visa_page' THEN 2 WHEN 'ghost' THEN 1 END AS kind_version,
                   CASE WHEN kind IN ('passport', 'visa_page') THEN 'passport' END AS plugin, kind IN ('passport', 'visa_page') AND len(issues) = 0 AS accepted,
                   CASE WHEN kind IN ('passport', 'visa_page') THEN issues[1].code ELSE 'missing_plugin' END AS first_issue
            FROM (SELECT *, ['passport','visa_page','old_card','ghost','stranger'][k % 5 + 1] AS kind FROM pass_plain)"""),
        "kind_completeness": q("cust", """
            SELECT kind, field, count(*) AS num_documents, count(*) FILTER (WHERE k % 9 <> 4 AND field <> 'seal') AS num_present,
                   round(1 - count(*) FILTER (WHERE k % 9 <> 4 AND field <> 'seal') / count(*), 9) AS missing_rate
            FROM (SELECT k, 'passport' AS kind, unnest(['passport_number', 'surname', 'expiry_date']) AS field FROM cust WHERE k % 5 = 0
                  UNION ALL SELECT k, 'visa_page', unnest(['passport_number', 'personal_number', 'seal']) FROM cust WHERE k % 5 = 1) GROUP BY ALL"""),
        "kind_quality": """
            WITH s AS (SELECT ['passport','visa_page','old_card','ghost'][l_linenumber % 4 + 1] AS plugin, l_discount * 10 AS blur, l_tax * 10 AS glare FROM lineitem),
            r AS (SELECT plugin, CASE plugin WHEN 'passport' THEN [CASE WHEN blur >= 0.3 THEN 'blur' END]
                                             WHEN 'visa_page' THEN [CASE WHEN blur >= 0.5 THEN 'blur' END, CASE WHEN glare >= 0.2 THEN 'glare' END] ELSE ['no_rules'] END AS reasons,
                         CASE plugin WHEN 'passport' THEN blur >= 0.6 WHEN 'visa_page' THEN blur >= 0.9 OR glare >= 0.4 ELSE true END AS review FROM s),
            t AS (SELECT plugin, review, list_filter(reasons, lambda x: x IS NOT NULL) AS reasons FROM r)
            SELECT plugin, CASE WHEN review THEN 'review' WHEN len(reasons) > 0 THEN 'enhanced' ELSE 'normal' END AS route, len(reasons) = 0 AS passed,
                   array_to_string(reasons, ',') AS reasons, count(*) AS num_images FROM t GROUP BY ALL""",
        "family_metrics": q("cust books book_judged", TWO_FAMILIES + """
            SELECT plugin, count(DISTINCT doc_id) AS num_documents, round(avg(m), 9) AS field_exact_match,
                   round(avg(m) FILTER (WHERE field IN ('mrz_lines', 'passport_number')), 9) AS critical_field_exact_match,
                   round(avg(m) FILTER (WHERE field = 'mrz_lines'), 9) AS mrz_line_exact_match,
                   round(avg(m) FILTER (WHERE field LIKE '%date%'), 9) AS date_exact_match, round(avg(m) FILTER (WHERE field LIKE '%number'), 9) AS number_exact_match,
                   round(avg(whole) FILTER (WHERE first), 9) AS document_success_rate, round(avg(CAST(decision = 'review' AS INTEGER)) FILTER (WHERE first), 9) AS review_rate,
                   round(count(*) FILTER (WHERE first AND accepted AND whole = 0) / nullif(count(*) FILTER (WHERE first AND accepted), 0), 9) AS false_accept_rate
            FROM pairs GROUP BY plugin"""),
        "family_report": q("cust books book_judged", TWO_FAMILIES + """
            SELECT plugin, field, round(avg(m), 9) AS exact_match, round(2.0 * sum(m) / nullif(count(*) + sum(given), 0), 9) AS f1, count(*) AS support,
                   CASE WHEN grouping(field) = 1 THEN round(avg(whole) FILTER (WHERE first), 9) END AS document_success_rate,
                   CASE WHEN grouping(field) = 1 THEN round(avg(CAST(NOT accepted AS INTEGER)) FILTER (WHERE first), 9) END AS review_rate
            FROM pairs GROUP BY GROUPING SETS ((plugin, field), (plugin))"""),
        "stored_report": q("scored", """
            SELECT '0.2.0' AS schema_version, 'booklets' AS report_name, '2026-01-01T00:00:00Z' AS generated_at, 'rendered' AS ocr_backend,
                   count(*) AS num_fixtures, count(*) FILTER (WHERE status = 'pass') AS num_passed, CAST(sum(num_matched_fields) AS BIGINT) AS num_matched_fields,
                   CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status, count(*) AS num_results,
                   count(*) FILTER (WHERE status = 'pass') AS num_passed_results, CAST(sum(num_matched_fields) AS BIGINT) AS num_matched_results FROM scored"""),
        "cause_classes": """
            WITH i AS (SELECT ['passport','train_ticket'][l_linenumber % 2 + 1] AS plugin, l_partkey % 13 + 1 AS c FROM lineitem)
            SELECT plugin, CASE WHEN c = 9 AND plugin = 'train_ticket' THEN 'scanner_error' ELSE
                   ['ocr_error','parser_error','ocr_error','ocr_error','schema_error','validator_error','ocr_error','quality_error','detect_error','layout_error','validator_error',
                    'policy_error','unclassified'][c] END AS root_cause,
                   ['missing_mrz_lines','missing_name','length_invalid','checksum_invalid','invalid_gender','birth_date_mismatch','region_code_invalid','blur_high','cropped_edge',
                    'layout_overlap','same_departure_arrival','house_rule','odd_code'][c] AS code, count(*) AS num_issues
            FROM i GROUP BY ALL""",
        "vocabulary_checks": """
            SELECT concat_ws(',', CASE WHEN o_orderkey % 6 = 5 THEN 'source' END, CASE WHEN o_orderkey % 4 = 3 THEN 'severity' END, CASE WHEN o_orderkey % 5 = 4 THEN 'angle' END) AS violations,
                   count(*) AS num_rows FROM orders GROUP BY ALL""",
        "train_variants": q("trains", f"""
            SELECT k AS doc_id, CASE WHEN k % 4 IN (1, 2) THEN 'boarding_pass_like' ELSE 'train_ticket' END AS document_variant,
                   CASE k % 4 WHEN 1 THEN 'CA' || (1000 + k % 9000) WHEN 2 THEN 'CZ3099' ELSE train_number END AS train_number,
                   CASE WHEN k % 4 IN (1, 2) THEN CASE WHEN {STATIONS}[k % 7 + 1] IN {AIRPORT_LIST} THEN {STATIONS}[k % 7 + 1] WHEN {STATIONS}[(k + 3) % 7 + 1] IN {AIRPORT_LIST} THEN {STATIONS}[(k + 3) % 7 + 1] END
                        ELSE departure_station END AS departure_station FROM trains"""),
        "id_side_issues": q("id_issues", """
            SELECT -k AS doc_id, CAST(seq AS INTEGER) AS seq, i.code AS code, i.severity AS severity, i.field AS field
            FROM (SELECT k, unnest(range(1, len(issues) + 1)) AS seq, unnest(issues) AS i FROM id_issues)
            UNION ALL SELECT s_suppkey, 1, 'missing_valid_from', 'error', 'valid_from' FROM supplier WHERE s_suppkey % 7 = 3
            UNION ALL SELECT s_suppkey, 2, 'missing_valid_to', 'error', 'valid_to' FROM supplier WHERE s_suppkey % 7 = 3"""),
        "plain_family": """
            SELECT doc_id, 'plain' AS plugin, '{"doc_type":"plain"}' AS field_values, true AS accepted, 1.0::DOUBLE AS score, 0 AS num_issues FROM documents""",
        "family_registry": """
            SELECT name, '0.1.0' AS version, description, 'document-plugin' AS tags, num_documents FROM (
                SELECT unnest(['boarding_pass','china_id','hukou_booklet','medical_record','passport','train_ticket']) AS name,
                       unnest(['boarding pass','resident identity card','household booklet member page','outpatient medical record','passport with machine-readable zone','train ticket']) AS description,
                       unnest([(SELECT count(*) FROM orders), (SELECT count(*) FROM customer), (SELECT count(*) FROM customer), (SELECT count(*) FROM part), (SELECT count(*) FROM customer), (SELECT count(*) FROM orders)]) AS num_documents)""",
    }
