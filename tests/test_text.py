"""Boundary literals of the text functions."""

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("1.250.000", 1250000.0), ("1.250,50", 1250.5), ("12.5", 12.5), ("12.500", 12500.0), ("1,234,567", None), ("4.500.000 TL", 4500000.0), ("abc", None), ("", None), (None, None)])
def test_numbers(spark, given, wanted):
    assert one(spark, T.to_number_tr(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("İstanbul / ÜSKÜDAR", "istanbul uskudar"), ("Bağ & Bahçe", "bag ve bahce"), ("Şişli Mah.", "sisli mah"), (None, "")])
def test_folding(spark, given, wanted):
    assert one(spark, T.normalize_text(F.lit(given).cast("string"))) == wanted


def test_locations(spark):
    assert one(spark, T.normalize_location(F.lit("Yeşilbağlar Mahallesi"))) == "yesilbaglar"
    assert one(spark, T.normalize_location(F.lit("Yeşil Bağlar Mh"), compact=True)) == "yesilbaglar"


@pytest.mark.parametrize(("report", "kind", "wanted"), [("LAND", "", "land"), ("", "Tarla", "land"), ("", "Dükkan", "commercial"), ("RESIDENTIAL", "Villa", "residential")])
def test_categories(spark, report, kind, wanted):
    assert one(spark, T.property_category(F.lit(report), F.lit(kind))) == wanted


@pytest.mark.parametrize(("room", "wanted"), [("3+1", True), ("2+1", True), ("1+1", False), ("3+2", False), ("1+0", False), (None, False)])
def test_rooms(spark, room, wanted):
    assert one(spark, T.room_compatible(F.lit(room).cast("string"), F.lit("3+1"))) is wanted
    if room is None:
        assert one(spark, T.room_compatible(F.lit(room).cast("string"), F.lit("3+1"), allow_unknown=True)) is True


@pytest.mark.parametrize(("given", "wanted"), [("Sıfır Bina", 0.0), ("10 yaş", 10.0), ("5-10", 5.0), ("yeni", 0.0), ("", None)])
def test_ages(spark, given, wanted):
    assert one(spark, T.building_age(F.lit(None).cast("double"), F.lit(given))) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("Bahçe Katı", 0.0), ("Bodrum", -1.0), ("Bodrum 2", -2.0), ("3. Kat", 3.0), ("", None)])
def test_floors(spark, given, wanted):
    assert one(spark, T.floor_value(F.lit(given))) == wanted


def test_dates(spark):
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, T.parse_date_tr(F.lit("05.03.2024"), as_of).cast("string")) == "2024-03-05 09:00:00"
    assert one(spark, T.parse_date_tr(F.lit("2024-03-05T10:00:00Z"), as_of).cast("string")) == "2024-03-05 10:00:00"
    assert one(spark, T.parse_date_tr(F.lit("?"), as_of).cast("string")) == "2024-01-01 00:00:00"


@pytest.mark.parametrize("given", ["0532 111 22 33", "+90 532 111 22 33", "5321112233", "0090 532 111 22 33"])
def test_phones(spark, given):
    assert one(spark, T.normalize_phone(F.lit(given))) == "+905321112233"


def test_years(spark):
    assert one(spark, T.infer_year(F.lit("1999 2003 2011 2010"))) == 2011
    assert one(spark, T.infer_year(F.lit("yok"))) == 0
    assert one(spark, T.infer_year(F.lit("2006 2001"))) == 0
    assert one(spark, T.infer_year(F.lit("2023 yılı, 2025 tahmini"))) == 2023


def test_folding_equals_decomposition(spark):
    """Every character below U+2200, alone and between letters, folds as what its canonical decomposition leaves."""
    import re
    import unicodedata

    def plain(text):
        for a, b in zip(T.TURKISH_FROM, T.TURKISH_TO, strict=True):
            text = text.replace(a, b)
        text = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text.lower()))
        return " ".join(re.sub("[^a-z0-9]+", " ", text.replace("'", "").replace("&", " ve ")).split())

    texts = [f"a{chr(k)}b {chr(k)}" for k in range(1, 0x2200)] + [unicodedata.normalize("NFD", "Şişli İğdır Çankaya"), "Łódź āēō", "ẹ́ q̇́"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text(F.col("t")).alias("x")).collect()
    assert [(r.t, r.x) for r in rows if r.x != plain(r.t)] == []
