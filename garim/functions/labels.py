"""Dimensions of the label registry: names, classes, categories, legal bases, risk floors, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RISKS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")

# Label, Korean name, attribute class, category, risk floor.
REGISTRY = (
    ("RRN", "주민등록번호", "identifier", "고유식별정보", 5),
    ("FRN", "외국인등록번호", "identifier", "고유식별정보", 5),
    ("BUSINESS_REG", "사업자등록번호", "quasi_identifier", "법인/사업자 식별정보", 2),
    ("CORP_REG", "법인등록번호", "quasi_identifier", "법인/사업자 식별정보", 3),
    ("DRIVER_LICENSE", "운전면허번호", "identifier", "고유식별정보", 4),
    ("PASSPORT", "여권번호", "identifier", "고유식별정보", 5),
    ("CARD", "카드번호", "identifier", "금융정보", 5),
    ("PNU", "토지번호", "general", "참조정보", 2),
    ("MEDICAL_INSURANCE", "건강보험증번호", "sensitive", "민감정보(건강)", 4),
    ("PRESCRIPTION_ID", "처방번호", "sensitive", "민감정보(건강)", 4),
    ("EDI_DRUG", "약품코드", "general", "참조정보", 2),
    ("FAX", "팩스번호", "general", "일반개인정보", 2),
    ("ACCOUNT", "계좌번호", "quasi_identifier", "금융정보", 4),
    ("EMPLOYEE_ID", "사번", "quasi_identifier", "일반개인정보", 3),
    ("PETITION_ID", "민원번호", "general", "참조정보", 2),
    ("COURT_CASE", "사건번호", "sensitive", "참조정보", 3),
    ("PHONE", "전화번호", "quasi_identifier", "일반개인정보", 3),
    ("EMAIL", "이메일", "quasi_identifier", "일반개인정보", 3),
    ("IP", "IP", "quasi_identifier", "일반개인정보", 3),
    ("URL", "URL", "general", "참조정보", 1),
    ("POSTAL_CODE", "우편번호", "quasi_identifier", "일반개인정보", 2),
    ("VEHICLE", "차량번호", "quasi_identifier", "일반개인정보", 3),
    ("DOC_ID", "문서번호", "general", "참조정보", 2),
    ("PERSON", "성명", "quasi_identifier", "일반개인정보", 4),
    ("ADDRESS", "주소", "quasi_identifier", "일반개인정보", 3),
    ("NATIONALITY", "국적", "general", "준식별자", 2),
    ("EDUCATION", "학력", "quasi_identifier", "준식별자", 3),
    ("MAJOR", "전공", "quasi_identifier", "준식별자", 2),
    ("POSITION", "직책", "quasi_identifier", "준식별자", 2),
    ("DT_BIRTH", "생년월일", "quasi_identifier", "준식별자", 4),
    ("AGE", "나이", "quasi_identifier", "준식별자", 1),
    ("HEIGHT", "신장", "quasi_identifier", "준식별자", 1),
    ("WEIGHT", "체중", "quasi_identifier", "준식별자", 1),
)
# Mode, least risk and confidence to block, least risk and confidence to review.
POLICIES = {
    "PARANOID": (2, 0.5, 1, 0.0),
    "STRICT": (3, 0.7, 2, 0.5),
    "BALANCED": (4, 0.8, 3, 0.6),
    "PERMISSIVE": (5, 0.95, 4, 0.7),
    "AUDIT": (6, 2.0, 6, 2.0),
}


def registry(spark: SparkSession) -> DataFrame:
    """The label dimension; its size is fixed."""
    return spark.createDataFrame(list(REGISTRY), "label string, ko_name string, attribute_class string, category string, risk_floor int")


def _chosen(place: int, label: Column, default: Column) -> Column:
    known = F.create_map(*[F.lit(x) for row in REGISTRY for x in (row[0], row[place])])
    return F.coalesce(known[label], default)


def ko_name(label: Column) -> Column:
    return _chosen(1, label, label)


def attribute_class(label: Column) -> Column:
    return _chosen(2, label, F.lit("general"))


def risk_floor(label: Column) -> Column:
    return _chosen(4, label, F.lit(3))


def risk_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), level)


def action(risk: Column, confidence: Column, mode: str) -> Column:
    """BLOCK, REVIEW or ALLOW under a mode."""
    if mode not in POLICIES:
        raise ValueError(f"unknown mode {mode}")
    block_risk, block_conf, review_risk, review_conf = POLICIES[mode]
    return (
        F.when((risk >= block_risk) & (confidence >= block_conf), "BLOCK")
        .when((risk >= review_risk) & (confidence >= review_conf), "REVIEW")
        .otherwise("ALLOW")
    )
