"""Golden documents with the field values they must give: fixed vectors."""


def box(x1, y1, x2, y2):
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]


BOARDING_LINES = [
    ("BOARDING PASS", 0.99, box(0, 0, 100, 10)),
    ("03DEC", 0.99, box(0, 20, 40, 30)),
    ("MU 2379", 0.99, box(50, 20, 90, 30)),
    ("TAIYUAN", 0.99, box(0, 40, 60, 50)),
    ("FUZHOU", 0.99, box(70, 40, 120, 50)),
    ("姓名 NAME", 0.99, box(0, 60, 60, 70)),
    ("ZHANGQIWEI", 0.99, box(70, 60, 140, 70)),
    ("ETKT 7813699238489/1", 0.99, box(0, 80, 140, 90)),
    ("G11", 0.99, box(150, 20, 170, 30)),
]

GOLDENS = {
    "id_front": ("china_id", [
        "中华人民共和国居民身份证", "姓名张三", "性别男 民族汉", "出生1990年03月07日",
        "住址北京市东城区东华门街道", "1001号", "公民身份号码110101199003074514",
    ], {
        "document_side": "front", "name": "张三", "gender": "男", "ethnicity": "汉", "birth_date": "1990年03月07日",
        "address": "北京市东城区东华门街道1001号", "id_number": "110101199003074514",
    }),
    "id_back": ("china_id", [
        "中华人民共和国居民身份证", "签发机关北京市公安局东城分局", "有效期限2010.01.01-2030.01.01",
    ], {
        "document_side": "back", "issuing_authority": "北京市公安局东城分局",
        "valid_from": "2010.01.01", "valid_to": "2030.01.01",
    }),
    "id_multiline": ("china_id", [
        "中华人民共和国居民身份证", "姓名 李四", "性别 女 民族 满", "出生 1988年12月01日", "住址 上海市浦东新区",
        "世纪大道2000弄", "88号1602室", "身份证号码 31010119881201242x",
    ], {
        "document_side": "front", "name": "李四", "gender": "女", "ethnicity": "满", "birth_date": "1988年12月01日",
        "address": "上海市浦东新区世纪大道2000弄88号1602室", "id_number": "31010119881201242X",
    }),
    "passport_lines": ("passport", [
        "P<UTO ERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36 UTO7408122F1204159ZE184226B<<<<<10",
    ], {
        "document_variant": "passport", "document_code": "P<", "issuing_country": "UTO", "surname": "ERIKSSON",
        "given_names": "ANNA MARIA", "passport_number": "L898902C3", "nationality": "UTO", "birth_date": "1974-08-12",
        "sex": "F", "expiry_date": "2012-04-15", "personal_number": "ZE184226B",
    }),
    "passport_text": ("passport",
        "Passport\nP«UTO ERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36 UTO7408122<1204159ZE184226B<<<<<10", {
        "document_variant": "passport", "document_code": "P<", "issuing_country": "UTO", "surname": "ERIKSSON",
        "given_names": "ANNA MARIA", "passport_number": "L898902C3", "nationality": "UTO", "birth_date": "1974-08-12",
        "sex": None, "expiry_date": "2012-04-15", "personal_number": "ZE184226B",
    }),
    "booklet_member": ("hukou_booklet", [
        "常住人口登记卡", "户号: 320101001234", "户主姓名: 王五", "住址", "南京市玄武区中山路88号", "姓名: 王小五",
        "与户主关系: 之女", "性别: Female", "身份证号: 32010120120709122X",
    ], {
        "doc_type": "hukou_booklet", "household_id": "320101001234", "householder_name": "王五",
        "address": "南京市玄武区中山路88号", "member_name": "王小五", "relation_to_head": "之女", "gender": "女",
        "birth_date": "2012-07-09", "id_number": "32010120120709122X",
    }),
    "booklet_labels_alone": ("hukou_booklet", [
        "常住人口登记卡", "户号", "330106000321", "户主姓名", "赵六", "住址", "杭州市西湖区学院路77号", "姓名", "赵小六",
        "与户主关系", "之子", "性别", "男", "公民身份号码", "330106201402023211",
    ], {
        "doc_type": "hukou_booklet", "household_id": "330106000321", "householder_name": "赵六",
        "address": "杭州市西湖区学院路77号", "member_name": "赵小六", "relation_to_head": "之子", "gender": "男",
        "birth_date": "2014-02-02", "id_number": "330106201402023211",
    }),
    "train_text": ("train_ticket", [
        ("中国铁路客票", 0.99), ("G1234", 0.99), ("SHANGHAI", 0.98), ("HANGZHOU", 0.98), ("2026-03-11 08:30", 0.97),
        ("二等座 05车12A号", 0.96), ("票号 E123456789", 0.95),
    ], {
        "document_variant": "train_ticket", "train_number": "G1234", "departure_station": "SHANGHAI",
        "arrival_station": "HANGZHOU", "departure_time": "2026-03-11", "ticket_number": None,
    }),
    "train_anchor": ("train_ticket", [
        ("中国铁路客票", 0.99, box(0, 0, 120, 20)), ("G87", 0.99, box(0, 30, 40, 50)),
        ("2026-03-12 07:45", 0.98, box(50, 30, 170, 50)), ("BEIJING", 0.97, box(0, 60, 80, 80)),
        ("SUZHOU", 0.97, box(90, 60, 160, 80)), ("姓名 NAME", 0.98, box(0, 90, 80, 110)),
        ("LI LEI", 0.96, box(90, 90, 150, 110)), ("WANG WU", 0.99, box(220, 150, 300, 170)),
        ("ETKT 1234567890123/1", 0.95, box(0, 120, 180, 140)),
    ], {
        "document_variant": "train_ticket", "train_number": "G87", "departure_station": "BEIJING",
        "arrival_station": "SUZHOU", "departure_time": "2026-03-12", "ticket_number": "1234567890123/1",
        "passenger_name": "LI LEI",
    }),
    "record_note": ("medical_record", [
        ("杭州市第一人民医院", 0.99), ("姓名: 张三", 0.98), ("性别: 男", 0.97), ("年龄: 34岁", 0.97),
        ("就诊日期: 2026年03月11日", 0.96), ("科室: 呼吸内科", 0.96), ("诊断: 上呼吸道感染；发热", 0.95),
        ("用药: 对乙酰氨基酚、阿莫西林", 0.95), ("备注: 建议多饮水休息", 0.94),
    ], {
        "doc_type": "medical_record", "hospital_name": "杭州市第一人民医院", "patient_name": "张三", "gender": "男",
        "age": "34", "visit_date": "2026-03-11", "department": "呼吸内科", "diagnosis": ["上呼吸道感染", "发热"],
        "medications": ["对乙酰氨基酚", "阿莫西林"], "notes": "建议多饮水休息",
    }),
    "boarding_inline": ("boarding_pass", BOARDING_LINES, {
        "document_variant": "boarding_pass", "passenger_name": "ZHANGQIWEI", "flight_number": "MU2379",
        "ticket_number": "7813699238489/1", "departure_date": "03DEC", "departure_airport": "TAIYUAN",
        "arrival_airport": "FUZHOU", "gate": "G11",
    }),
    "train_boarding_like": ("train_ticket", BOARDING_LINES, {
        "document_variant": "boarding_pass_like", "train_number": "MU2379", "departure_station": "TAIYUAN",
        "arrival_station": "FUZHOU",
    }),
}
