import pytest
from pyspark.sql import functions as F

from lonja.functions import keys, text


def check(spark, f, cases):
    df = spark.createDataFrame(list(cases.items()), f"t string, w {'string' if all(isinstance(v, (str, type(None))) for v in cases.values()) else 'double'}")
    assert df.where(~f(F.col("t")).cast(df.schema["w"].dataType).eqNullSafe(F.col("w"))).collect() == []


@pytest.mark.parametrize("f,cases", [
    (keys.company_id, {"20-77225910-6": "20772259106", "RUC 20500598568": "20500598568", "20520668886.0": "20520668886", " 20218902871 ": "20218902871", "0": None, "00000000000": None, "2007402512": None, " ": None}),
    (keys.quarter, {"1er Trimestre": 1.0, "2DO TRIM.": 2.0, "T3": 3.0, "IV Trimestre": 4.0, "Primer Trimestre": 1.0, "Segundo Trimestre": 2.0, "III Trimestre": 3.0, "Cuarto Trimestre": 4.0, "Anual": None, "": None, "I Trimestre": 1.0}),
    (keys.information_type, {"I": "INDIVIDUAL", "Indiv.": "INDIVIDUAL", "CONSOLIDADO": "CONSOLIDADA", "Consol.": "CONSOLIDADA", "C": "CONSOLIDADA", "": None, "Otra": "OTRA"}),
    (keys.text_value, {"n.d.": None, " - ": None, "": None, "NaN": None, " 85 ": "85"}),
    (keys.ticker, {" abc ": "ABC", "  ": None}),
    (text.series_date, {"02Ene97": "1997-01-02", "01Set98": "1998-09-01", "15Sep98": "1998-09-15", "27Set26": "2026-09-27", "31Dic89": "2089-12-31", "05Xyz01": None, "31Feb13": None, "": None}),
    (text.day, {"04/01/2021": "2021-01-04", "2021-01-04T00:00:00": "2021-01-04", "xx": None}),
    (text.half_day_time, {"28/03/2025 12:00:00 a.m.": "2025-03-28 00:00:00", "27/03/2025 05:57:33 p. m.": "2025-03-27 17:57:33", "x": None}),
    (text.series_number, {"2.618": 2.618, "n.d.": None, "N.D.": None, " ": None, "3,75": 3.75}),
    (lambda c: text.series_number(c, "thousands"), {"1,234.5": 1234.5, "3,75": 375.0}),
    (text.company_name, {"Compañía Minera  S.A.A.": "COMPANIA MINERA S A A", "   ": None}),
])
def test_texts(spark, f, cases):
    check(spark, f, {**cases, None: None})


def test_hash_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")
    assert df.select(text.payload_hash("a", "b")).distinct().count() == 2
