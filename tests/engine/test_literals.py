"""Scalar rules on literal rows: the spellings, and what they must become."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import analysis, repair, text

#: Ways to write one number, and what they must become.
NUMBERS = [("512-р", "512-р"), ("512-Р", "512-р"), ("№ 512-р", "512-р"), ("№512 - р", "512-р"), ("512 – р", "512-р"), ("512—р", "512-р"), (" 512-p ", "512-р"), ("N512-P", "512-р"), ("No 512-р", "512-р"), ("№ 512-р", "512-р"), ("84-PC", "84-рс"), ("131-ФЗ", "131-фз"), (None, "")]
HYPHENS = [("благоустрой-\nство", "благоустройство"), ("город-курорт", "город-курорт"), ("Ивано-\nПетров", "Ивано-\nПетров"), ("пере­\n нос", "перенос"), ("12-\nр", "12-\nр")]
SCRIPTS = [("Cочи", "Сочи"), ("pешение", "решение"), ("город", "город"), ("city", "city"), ("Zлово", "Zлово"), ("cityо", "cityo"), ("512-p от", "512-р от"), ("№ 512…", "№ 512…")]
TECHNICAL = [("028e97063df6b807dc50e5901603af2e.docx", "true"), ("tg7dcgl1954sjipys673nrc12y1zd6o0.docx", "true"), ("0f8fad5b-d9cb-469f-a165-70867728950e", "true"), ("postanovlenie-512.pdf", "false"), ("abcdefghijklmnopqrstuvwxyz", "false"), ("short1.pdf", "false")]
NUMBER_SHAPES = [("№ 512", "true"), ("512-р", "true"), ("благоустройство", "false")]
DATES = [("2024-03-14", "14 марта 2024"), ("2024-13-01", "2024-13-01"), ("скоро", "скоро")]
GUARD = [("=1+1", "''=1+1"), ("+7", "''+7"), ("-x", "''-x"), ("@a", "''@a"), ("plain", "plain"), (None, "")]
PARTS = [("512-р", "512 р 512р"), ("84 рс", "84 рс"), ("№ 7", "7")]
LONG_BREAKS = [("пе-\nре-\n  но-\nсы-\nва-\nют", "переносывают"), ("a-\nb", "a-\nb")]
RULES = [
    (NUMBERS, repair.document_number), (HYPHENS, repair.join_hyphens), (LONG_BREAKS, repair.join_hyphens), (SCRIPTS, repair.repair), (TECHNICAL, text.technical_name), (NUMBER_SHAPES, repair.looks_like_number),
    (DATES, text.format_date), (GUARD, text.csv_guard), (PARTS, lambda c: F.array_join(analysis.number_terms(c), " ")),
]


@pytest.mark.parametrize("k", range(len(RULES)))
def test_literal_rows(spark, k):
    rows, rule = RULES[k]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "id int, v string")
    got = [r.want for r in df.select("id", rule(F.col("v")).cast("string").alias("want")).orderBy("id").collect()]
    assert got == [want.replace("''", "'") for _, want in rows]
