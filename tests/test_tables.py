import io
import zipfile

from pyspark.sql import functions as F

from garim.operators import analytics, evaluation, fpe, masking, tabular, vault
from garim.operators.detectors import detect
from garim.sources import files
from garim.streaming import jobs


def test_vault_round_trip(spark):
    texts = [(1, "a@x.com 010-1234-5678 b@x.com a@x.com"), (2, "b@x.com"), (3, "none"), (4, None)]
    found = masking.with_actions(detect(spark.createDataFrame(texts, "doc_id long, text string")), "STRICT")
    long = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.label", "s.text", "s.start", "s.risk_level")
    entries = vault.entries(long)
    tokens = {(r.doc_id, r.original): r.token for r in entries.collect()}
    assert tokens == {(1, "a@x.com"): "<EMAIL_1>", (1, "b@x.com"): "<EMAIL_2>", (1, "010-1234-5678"): "<PHONE_1>", (2, "b@x.com"): "<EMAIL_1>"}
    out = vault.tokenize(found, entries)
    rows = {r.doc_id: (r.text_out, r.restored) for r in vault.restore(out, entries).collect()}
    assert rows[1] == ("<EMAIL_1> <PHONE_1> <EMAIL_2> <EMAIL_1>", texts[0][1]) and rows[3] == ("none", "none") and rows[4] == (None, None)
    asked = spark.createDataFrame([(1, "<EMAIL_2>"), (1, "<EMAIL_9>")], "doc_id long, token string")
    assert {r.token: r.original for r in vault.reveal(asked, entries).collect()} == {"<EMAIL_2>": "b@x.com", "<EMAIL_9>": None}


def test_k_anonymity(spark):
    rows = [("a", 1), ("a", 1), ("b", None), ("b", None), ("b", None)]
    df = spark.createDataFrame(rows, "x string, y int")
    r = analytics.k_anonymity(df, ["x", "y"], 2).first()
    assert (r.k, r.group_count, r.record_count, r.smallest_group, r.satisfies_threshold) == (2, 2, 5, "a|1", True)
    assert analytics.k_anonymity(df, []).first().satisfies_threshold and analytics.k_anonymity(df, []).first().k == 5
    empty = analytics.k_anonymity(df.limit(0), ["x"]).first()
    assert (empty.k, empty.satisfies_threshold) == (0, False)


def test_rates_and_leakage(spark):
    gold = spark.createDataFrame([(1, "A", 0, 5), (1, "B", 3, 6), (2, "A", 0, 2)], "doc_id int, label string, start int, end int")
    predicted = spark.createDataFrame([(1, "A", 4, 9), (1, "A", 10, 12), (2, "B", 0, 2)], "doc_id int, label string, start int, end int")
    rows = {r.label: (r.tp, r.fp, r.fn) for r in evaluation.by_label(gold, predicted).collect()}
    assert rows == {"A": (1, 1, 1), "B": (0, 1, 1)}
    total = evaluation.overall(evaluation.by_label(gold, predicted)).first()
    assert (total.tp, total.fp, total.fn) == (1, 2, 2)
    a = spark.createDataFrame([("x  y",), ("z",)], "text string")
    assert [r.key for r in evaluation.leakage(a, spark.createDataFrame([(" x y ",)], "text string")).collect()] == ["x y"]


def test_tables_are_masked_by_header(spark):
    df = spark.createDataFrame([("홍길동", "010-1234-5678", "keep", ""), (None, "02-123-4567", None, "x")], "`성 명` string, `휴대폰 번호` string, note string, email string")
    assert tabular.map_columns(df.columns) == {"성 명": "PERSON", "휴대폰 번호": "PHONE", "email": "EMAIL"}
    rows = [tuple(r) for r in tabular.mask_columns(df, "partial").collect()]
    assert rows == [("홍OO", "010-****-5678", "keep", ""), (None, "02-***-4567", None, "*")]


def test_format_is_preserved(spark):
    values = [("RRN", "900101-1234567"), ("CARD", "4111-1111-1111-1111"), ("PHONE", "010-1234-5678"), ("EMAIL", "abcd@x.com"), ("PASSPORT", "M12345678"), ("OTHER", "가A1-b")]
    out = {r.label: r.fpe_value for r in fpe.format_preserving(spark.createDataFrame([*values, values[0]], "label string, original string"), "s").collect()}
    again = {r.label: r.fpe_value for r in fpe.format_preserving(spark.createDataFrame(values, "label string, original string"), "s").collect()}
    assert out == again and len(out) == 6 and all(out[k] != v for k, v in values)
    check = spark.sql(f"select luhn_check(replace('{out['CARD']}', '-', '')) as ok").first().ok
    assert check and out["CARD"].startswith("4111-11") and out["PHONE"].startswith("010-") and out["EMAIL"].endswith("@x.com") and out["RRN"][7] == "1"


def test_files(spark, tmp_path):
    def packed(parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return data.getvalue()

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("안녕".encode("cp949"))
    (tmp_path / "in/b.docx").write_bytes(packed({"word/document.xml": "<d xmlns:w='w'><w:p><w:t>hi</w:t><w:tab/><w:t>you</w:t></w:p></d>"}))
    sheet = "<s><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row></s>"
    (tmp_path / "in/c.xlsx").write_bytes(packed({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<x><si><t>name</t></si></x>"}))
    (tmp_path / "in/d.docx").write_bytes(b"broken")
    (tmp_path / "in/e.bin").write_bytes(b"no")
    rows = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.read_texts(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.txt": ("안녕", None), "b.docx": ("hi\tyou\n", None), "c.xlsx": ("name\t\t7", None), "d.docx": (None, "BadZipFile")}
    (tmp_path / "r.csv").write_text('name;note\n"a";"x\ny"\n;\n')
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path / "r.csv")).collect()] == [("a", "x\ny")]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a@x.com"), ("2024-01-01 00:02:00", "a@x.com b@x.com"), ("2024-01-01 02:00:00", "none")]
    df = spark.createDataFrame(rows, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    query = jobs.detection_rate(stream, include=["EMAIL"]).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.label, r.n) for r in spark.table("rates").collect()] == [("EMAIL", 3)]
    values = stream.select(F.lit("EMAIL").alias("label"), F.explode(F.split("text", " ")).alias("original"))
    query = jobs.number_tokens(values).writeStream.format("memory").queryName("tokens").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    tokens = {(r.original, r.token) for r in spark.table("tokens").collect()}
    assert len(tokens) == 3 and len({t for _, t in tokens}) == 3
