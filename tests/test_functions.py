"""Golden rows of the string, code, date and score functions."""

import pytest
from pyspark.sql import functions as F

from docustrata.functions import codes, dates, scores, text
from docustrata.operators import conversation, html, resolve


def value(spark, column, *args, schema="a string"):
    return spark.createDataFrame([args], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "clean"), [(" СП 20.13330 — 2016; ", "СП 20.13330-2016"), ("ГОСТ 1 / 2 ,", "ГОСТ 1/2"), ("гост 5 ‐ 7:", "гост 5-7"), ("", ""), (None, None)])
def test_clean_code(spark, raw, clean):
    assert value(spark, text.clean_code(F.col("a")), raw) == clean


def test_text_kernel(spark):
    assert value(spark, text.squeeze(F.col("a")), " a\t\nb  ") == "a b"
    assert value(spark, text.truncate_for_log(F.col("a"), 6), "abcdefgh") == "abc..."
    assert value(spark, text.tokens(F.col("a")), "Ёлка ouè 5 a СП-20") == ["ёлка", "ou", "5", "сп", "20"]
    assert value(spark, text.locator(F.col("a")), "Пункт 5.2") == "5.2"
    assert value(spark, text.locator(F.col("a")), "п. 5 - 2") == "52"
    assert value(spark, text.common_path(F.lit("a > b > c"), F.lit("a > b > d")), "") == "a > b"
    assert value(spark, text.chunks(F.col("a"), 2), "abcde") == ["ab", "cd", "e"]
    assert value(spark, text.chunks(F.col("a"), 2), "") == []
    assert value(spark, text.content_hash(F.col("a")), "a  b\r\n\r\nc") == value(spark, text.content_hash(F.col("a")), " a b\nc ")
    with pytest.raises(ValueError):
        text.truncate_for_log(F.col("a"), 0)


def test_codes(spark):
    assert value(spark, codes.code_variants(F.col("a")), "СП 20.13330.2016") == ["СП 20.13330.2016", "СП20.13330.2016", "СП 20.13330", "СП20.13330", "СП 20", "СП20"]
    assert value(spark, codes.family(F.col("a")), "СП 20.13330.2016") == "СП20"
    assert value(spark, codes.family(F.col("a")), "ГОСТ Р 52-2005") == "ГОСТ Р 52"
    assert value(spark, codes.alias_form(F.col("a")), "https://A.example/x/?q=1#f") == "a.example/x?q=1"
    assert value(spark, codes.alias_form(F.col("a")), "«СП (20)», [7]") == "«сп 20 » 7"
    assert value(spark, codes.is_placeholder(F.col("a"), F.col("a")), "СП 5.0") is True


def test_dates(spark):
    assert str(value(spark, dates.dotted_date(F.col("a")), "05.03.2019")) == "2019-03-05"
    assert value(spark, dates.dotted_date(F.col("a")), "35.03.2019") is None
    assert str(value(spark, dates.written_date(F.col("a")), "5 марта 2019 г.")) == "2019-03-05"
    assert str(value(spark, dates.publication_date(F.col("a")), "2020")) == "2020-01-01"


def test_scores(spark):
    pair = "a array<double>, b array<double>"
    assert value(spark, scores.cosine(F.col("a"), F.col("b")), [1.0, 0.0], [1.0, 1.0], schema=pair) == pytest.approx(0.7071, abs=1e-4)
    assert value(spark, scores.cosine(F.col("a"), F.col("b")), [0.0, 0.0], [1.0, 1.0], schema=pair) == 0.0
    with pytest.raises(Exception, match="differ in length"):
        value(spark, scores.cosine(F.col("a"), F.col("b")), [1.0], [1.0, 1.0], schema=pair)
    q = "a string, b string, c string"
    score = scores.locator_score(F.col("a"), F.col("b"), F.col("c"))
    assert [value(spark, score, *r, schema=q) for r in (("5.2", "5.2", ""), ("5", "5.2", ""), ("5.2", "5", ""), ("5", "7", "a 5 b"), ("5", None, None))] == [1.06, 0.96, 0.90, 0.82, 0.0]


def test_code_bonus_penalizes_other_years(spark):
    bonus = lambda cs, c: value(spark, resolve.code_bonus(F.array(*[F.lit(x) for x in cs]), F.lit(c)), "")
    assert bonus(["СП 20.13330.2016"], "СП 20.13330.2016") == pytest.approx(0.35)
    assert bonus(["СП 20"], "СП 20.13330.2016") == pytest.approx(0.22)
    assert bonus(["СП 20.13330.2011"], "СП 20.13330.2016") == pytest.approx(0.18 - 0.28)


def test_rerank_prefers_modern_and_newest(spark):
    rows = [(1, "D1", 1.0, "СП 20.13330.2016", "a", True, False, ["СП 20"], ["нагрузка"]), (1, "D2", 1.0, "СП 20.13330.2011", "a", True, False, ["СП 20"], ["нагрузка"]), (1, "D3", 1.0, "СНиП 2.01.07-85", "a", False, True, ["СП 20"], ["нагрузка"]), (1, "D4", 9.0, "СП 5.0", "СП 5.0", True, False, [], [])]
    c = spark.createDataFrame(rows, "q int, document_id string, score double, display_code string, title string, is_active boolean, is_outdated boolean, codes array<string>, tokens array<string>")
    got = [(r.document_id, r.score) for r in resolve.reranked(c, "q", topics=((("нагруз",), (("СП 20", 0.2),)),)).orderBy("rk").collect()]
    assert [g[0] for g in got] == ["D1", "D2", "D3"]
    assert got[0][1] == pytest.approx(1.0 + 0.22 + 0.2 + 0.1 + 0.16)


def test_pages(spark):
    page = '<html><header>h</header><div class="crumbs_span">c</div><div class="contener_doc"><p>A  b</p><script>x</script><p>C</p></div><p>out</p><a href="x.pdf">P</a></html>'
    got = html.read_pages(spark.createDataFrame([(1, "http://h/d/", page), (2, None, None)], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert got[0].text == "A b\nC"
    assert got[0].links[0].href == "http://h/d/x.pdf"
    assert (got[1].text, got[1].links) == ("", [])


def test_threads(spark):
    t = conversation.threads_after(F.array(F.lit("нагрузка :: x")), F.col("a"), F.lit("Какая нагрузка"), F.lit("мало"))
    assert value(spark, t, "partial") == ["нагрузка :: x", "Какая нагрузка :: мало"]
    assert value(spark, t, "direct") == []
