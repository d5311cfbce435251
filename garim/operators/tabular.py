"""Column-wise masking of tables by their headers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garim.operators.masking import substitute

# Headers and the labels of their columns, in the order in which they are tried.
HEADERS = {
    "성명": "PERSON", "이름": "PERSON", "성함": "PERSON", "신청인": "PERSON", "민원인": "PERSON", "기안자": "PERSON", "수신자": "PERSON", "당사자": "PERSON", "환자명": "PERSON", "환자": "PERSON", "name": "PERSON", "Name": "PERSON", "NAME": "PERSON", "성명(한글)": "PERSON",
    "주민번호": "RRN", "주민등록번호": "RRN", "주민": "RRN", "rrn": "RRN", "RRN": "RRN",
    "외국인등록번호": "FRN", "외등번호": "FRN",
    "사업자등록번호": "BUSINESS_REG", "사업자번호": "BUSINESS_REG", "biz_reg": "BUSINESS_REG",
    "법인등록번호": "CORP_REG", "법인번호": "CORP_REG",
    "운전면허번호": "DRIVER_LICENSE", "면허번호": "DRIVER_LICENSE",
    "여권번호": "PASSPORT", "여권": "PASSPORT",
    "카드번호": "CARD", "신용카드번호": "CARD", "체크카드번호": "CARD",
    "건강보험증번호": "MEDICAL_INSURANCE", "건강보험번호": "MEDICAL_INSURANCE",
    "처방번호": "PRESCRIPTION_ID", "처방전번호": "PRESCRIPTION_ID",
    "전화번호": "PHONE", "연락처": "PHONE", "휴대전화": "PHONE", "휴대폰": "PHONE", "휴대폰번호": "PHONE", "핸드폰": "PHONE", "이동전화": "PHONE", "휴대전화번호": "PHONE", "phone": "PHONE", "tel": "PHONE", "Tel": "PHONE", "TEL": "PHONE", "Phone": "PHONE",
    "팩스": "FAX", "팩스번호": "FAX",
    "이메일": "EMAIL", "전자우편": "EMAIL", "메일": "EMAIL", "email": "EMAIL", "Email": "EMAIL", "E-mail": "EMAIL", "EMAIL": "EMAIL",
    "주소": "ADDRESS", "거주지": "ADDRESS", "도로명주소": "ADDRESS", "지번주소": "ADDRESS", "address": "ADDRESS", "Address": "ADDRESS",
    "우편번호": "POSTAL_CODE", "우편": "POSTAL_CODE", "zip": "POSTAL_CODE", "zipcode": "POSTAL_CODE", "Zip": "POSTAL_CODE",
    "차량번호": "VEHICLE", "자동차번호": "VEHICLE", "차량": "VEHICLE",
    "계좌번호": "ACCOUNT", "계좌": "ACCOUNT", "통장번호": "ACCOUNT", "은행계좌": "ACCOUNT",
    "사번": "EMPLOYEE_ID", "공무원번호": "EMPLOYEE_ID", "직원번호": "EMPLOYEE_ID", "교번": "EMPLOYEE_ID",
    "IP": "IP", "ip": "IP", "IP주소": "IP", "ip_address": "IP",
    "URL": "URL", "url": "URL", "홈페이지": "URL", "웹사이트": "URL",
    "PNU": "PNU", "필지고유번호": "PNU", "토지고유번호": "PNU",
    "약품코드": "EDI_DRUG", "의약품코드": "EDI_DRUG",
    "사건번호": "COURT_CASE",
}


def map_columns(headers: list[str]) -> dict[str, str]:
    """The label of each header that tells one: exactly, without white space, or by a part of it."""
    found = {}
    for header in headers:
        bare = re.sub(r"\s+", "", header)
        label = HEADERS.get(header) or HEADERS.get(bare) or next((v for k, v in HEADERS.items() if len(k) >= 2 and k in header), None)
        if label:
            found[header] = label
    return found


def label_of(header: Column) -> Column:
    """As `map_columns`, of a header in a column; null where it tells none."""
    names = F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair])
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(v).alias("label")) for k, v in HEADERS.items() if len(k) >= 2])
    return F.coalesce(
        F.try_element_at(names, header),
        F.try_element_at(names, F.regexp_replace(header, r"\s+", "")),
        F.try_element_at(F.transform(F.filter(parts, lambda x: F.contains(header, x["part"])), lambda x: x["label"]), F.lit(1)),
    )


def mask_columns(df: DataFrame, strategy: str, columns: dict[str, str] | None = None, salt: str = "") -> DataFrame:
    """df with every cell of a labelled column masked whole; null and empty cells and other columns stay."""
    columns = map_columns(df.columns) if columns is None else columns
    masked = {
        c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.col(c)).otherwise(substitute(F.lit(label), F.col(c).cast("string"), strategy, salt))
        for c, label in columns.items()
    }
    return df.withColumns(masked) if masked else df
