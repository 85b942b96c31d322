from dataclasses import replace

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import web
from textloom.profile import GENERIC, LEGAL_AR


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_normalize_folds_letters_and_space(spark):
    assert one(spark, T.normalize("x", LEGAL_AR), "  الأَحوال  الشخصيّة ") == "الاحوال الشخصيه"
    assert one(spark, T.normalize("x"), None) == ""


def test_reference_numbers_ranges_and_bare_lines(spark):
    got = one(spark, T.reference_numbers("x", LEGAL_AR), "المادة ٤٣٨ و المواد 3-5\n ٧ \nالمادة 10-90")
    assert got == ["438", "3", "4", "5", "10", "90", "7"]


def test_padded_round_trip(spark):
    assert one(spark, T.padded(T.reference_numbers("x", LEGAL_AR)), "المادة 31 المادة 57") == ",31,57,"
    assert one(spark, T.unpadded("x"), ",31,57,") == ["31", "57"]
    assert one(spark, T.unpadded("x"), "") == []


def test_article_asked(spark):
    assert one(spark, T.article_asked("x", LEGAL_AR), "ما نص المادة ٠٤٧") == "47"
    assert one(spark, T.article_asked("x", LEGAL_AR), "م ٤٧ من القانون") == "47"
    assert one(spark, T.article_asked("x", LEGAL_AR), "بلا رقم") is None


def test_citations_pivot(spark):
    got = one(spark, T.citations("x", LEGAL_AR), "رقم (١١١) لسنة 1969 و رقم 024/60 و رقم 111 لسنة 1969")
    assert [(r["num"], r["year"]) for r in got] == [("111", "1969"), ("24", "1960")]


def test_core_title(spark):
    assert one(spark, T.core_title("x", LEGAL_AR), "قانون العقوبات رقم 111 لسنة 1969 (المعدل)") == "قانون العقوبات"
    assert one(spark, T.core_title("x", LEGAL_AR), "قانون رقم 5 لسنة 2000") == ""


def test_boundary(spark):
    df = spark.createDataFrame([("قانون العمل", "تعديل قانون العمله"), ("قانون العمل", "تعديل قانون العمله و قانون العمل رقم 3"), ("قانون العمل", "x")], "c string, h string")
    assert [r[0] for r in df.select(T.bounded_in(F.col("c"), F.col("h"), LEGAL_AR)).collect()] == [False, True, False]


def test_overview_and_lookup(spark):
    assert one(spark, T.is_overview("x", LEGAL_AR), "ما هو قانون العقوبات؟") is True
    assert one(spark, T.is_overview("x", LEGAL_AR), "ما هي عقوبة السرقة في قانون العقوبات؟") is False
    assert one(spark, T.is_exact_lookup("x", LEGAL_AR), "المادة 438 من قانون العقوبات") is True
    assert one(spark, T.is_exact_lookup("x", LEGAL_AR), "ما عقوبة المادة 438") is False


def test_phrases_and_needles(spark):
    assert one(spark, T.instrument_phrases("x", LEGAL_AR), "ما حكم ذلك حسب قانون العمل في العراق") == ["قانون العمل", "قانون العمل في العراق"]
    needles = one(spark, T.title_needles("x", LEGAL_AR), "ما هو قانون العقوبات؟")
    assert needles == sorted(needles, key=len, reverse=True) and "قانون العقوبات" in needles


def test_content_tokens_longest_first(spark):
    assert one(spark, T.content_tokens("x"), "What is the quick (brown) fox, quick 123 it?") == ["quick", "brown", "fox"]


def test_penalty_fit_and_danger(spark):
    df = spark.createDataFrame([("قانون تعديل قانون العقوبات", "قانون العقوبات")], "t string, q string")
    r = df.select(T.title_penalty(F.col("t"), F.col("q"), LEGAL_AR).alias("p"), T.phrase_fit(F.col("t"), F.col("q")).alias("f"), T.dangerous_alias(F.col("t"), F.col("q"), LEGAL_AR).alias("d"), T.phrase_fit(F.col("q"), F.col("q")).alias("g")).first()
    assert (r.p, r.f, r.d, r.g) == (38.0, -22.0 - 16.0, True, 22.0)


def test_title_aliases(spark):
    got = one(spark, T.title_aliases("x", LEGAL_AR), "قانون العقوبات رقم 111 لسنة 1969")
    assert got == ["قانون العقوبات رقم 111 لسنة 1969", "قانون العقوبات", "العقوبات"]


def test_dates(spark):
    for raw, want in [("٠٥-٠٣-١٩٩٩", "1999-03-05"), ("1999-03-05", "1999-03-05"), ("31/2/2001", "2001-02-31"), ("40-1-2000", ""), (None, ""), ("۵.۶.۲۰۰۱", "2001-06-05")]:
        assert one(spark, web.date_iso("x"), raw) == want


def test_status(spark):
    df = spark.createDataFrame([("N", None), (None, None), ("Y", "R")], "v string, f string")
    assert [r[0] for r in df.select(web.status_of("v", "f", "R", "ok", "gone")).collect()] == ["gone", "ok", "gone"]


def test_html(spark):
    assert one(spark, web.html_to_text("x"), "<p> a &amp; b<br>c</p>\r\n<i>d</i>&nbsp;") == "a & b\nc\nd"
    page = '<script>var articles = [{"articleID":2,"articleCodeTxt":"B","displayOrder":2,"articleText":"<p>two ] x</p>"},{"articleID":1,"articleCodeTxt":"A","displayOrder":null,"articleText":"one"}];</script>'
    assert one(spark, web.page_full_text("x"), page) == "A\none\n\nB\ntwo ] x"
    assert one(spark, web.page_full_text("x"), "nothing") == ""
    assert one(spark, web.is_challenge("x"), "<title>Just a moment...</title>") is True


def test_client_ip_and_truncation(spark):
    df = spark.createDataFrame([(" 1.2.3.4, 9.9.9.9", "p"), (None, None)], "f string, p string")
    assert [r[0] for r in df.select(web.client_ip("f", "p")).collect()] == ["1.2.3.4", "unknown"]
    assert one(spark, T.truncated("x", 10), "abcdef\nxyz 123") == "abcdef…"
    assert one(spark, T.truncated("x", 10), "short") == "short"
    assert one(spark, T.looks_truncated("x"), "ends here. ") is False
    assert one(spark, T.looks_truncated("x"), "cut he") is True


def test_generic_profile_is_a_value():
    assert replace(GENERIC, min_core=3).min_core == 3
