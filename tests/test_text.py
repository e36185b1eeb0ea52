import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'int' if n in ('year', 'a', 'b') else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    ("пере-\nнос слова", "перенос слова"), ("вос@\nпроизведение", "воспроизведение"), ("soft­\n hyphen", "softhyphen"), ("ядро@оболочка", "ядро-оболочка"),
    ("mail a@b.c", "mail a@b.c"), ("one\n two   three", "one two three"), ("  x \n", "x"), ("", ""), (None, None),
])
def test_clean_block(spark, raw, clean):
    assert one(spark, T.clean_block(F.col("t")), t=raw) == clean


@pytest.mark.parametrize("text, name, year", [
    ("in 1998 and 2011", "a.pdf", 2011), ("in 1998", "Study 2020.pdf", 2020), ("in 2001", "study_2021.pdf", 2001), ("in 2005", "2028 and 2020.pdf", 2005),
    ("in 2029 or 3015", "x.pdf", None), ("", "", None), (None, "2010.pdf", 2010),
])
def test_year(spark, text, name, year):
    assert one(spark, T.find_year(F.col("t"), F.col("f")), t=text, f=name) == year


@pytest.mark.parametrize("raw, doi", [("see 10.1234/abc.5).", "10.1234/abc.5"), ("DOI: 10.98000/x.1;", "10.98000/x.1"), ("10.12/short", None), ("", None), (None, None)])
def test_doi(spark, raw, doi):
    assert one(spark, T.find_doi(F.col("t")), t=raw) == doi


@pytest.mark.parametrize("authors, name", [
    ("Smith, J.; Doe, A.", "Smith"), ("John Smith and Ann Doe", "Smith"), ("Иванов И.", "Иванов"), ("O'Neil, P.", "O'Neil"), ("", ""), (None, ""), ("A. B.", ""), ("Doe, Ann, and Roe", "Doe"),
])
def test_first_author(spark, authors, name):
    assert one(spark, T.first_author(F.col("a_")), a_=authors) == name


def test_citation_and_key(spark):
    args = (F.col("au"), F.col("year"), F.col("f"))
    assert one(spark, T.citation(*args), au="Smith, J.; Doe, A.", year=2020, f="x.pdf") == "Smith et al., 2020"
    assert one(spark, T.citation(*args), au="Smith, J.", year=0, f="x.pdf") == "Smith"
    assert one(spark, T.citation(*args), au=None, year=2001, f="x.pdf") == "[x.pdf], 2001"
    key = T.cite_key(F.col("au"), F.col("year"), F.col("t"), F.col("f"))
    assert one(spark, key, au="McDonald, R.", year=2001, t="", f="x.pdf") == "Mcdonald2001"
    assert one(spark, key, au="", year=None, t="On the ashes", f="x.pdf") == "AshesND"
    assert one(spark, key, au=None, year=2001, t=None, f="a b-1.pdf") == "ab12001"
    assert one(spark, key, au=None, year=None, t=None, f="-.pdf") == "DocND"


@pytest.mark.parametrize("line, section", [
    ("2. Results and Discussion", "Results and discussion"), ("ВЫВОДЫ.", "Выводы"), ("3.1 Heating of straw", "Heating of straw"), ("Results show that", None), ("x" * 91, None),
    ("1. Ends with a stop. no", None), ("  Methods  ", "Methods"), ("", None),
])
def test_section(spark, line, section):
    assert one(spark, T.detect_section(F.col("t")), t=line) == section


def test_topics_labels_snippets(spark):
    assert one(spark, T.topic_variants(F.col("t")), t="Получение масел: отжим семян, очистка") == ["Получение масел: отжим семян, очистка", "Получение масел", "отжим семян, очистка", "Получение масел: отжим семян"]
    assert one(spark, T.topic_keywords(F.col("t")), t="Основные процессы получения биогаза и гидролиза отходов земледелия") == ["получен", "биогаза", "гидроли", "отходов"]
    assert one(spark, T.page_label(F.col("a"), F.col("b")), a=3, b=3) == "стр. 3" and one(spark, T.page_label(F.col("a"), F.col("b")), a=3, b=5) == "стр. 3–5"
    assert one(spark, T.source_label(F.col("t")), t="Lecture_9__gas (2).pdf") == "Lecture 9 gas" and one(spark, T.source_label(F.col("t")), t="w" * 60 + ".pdf") == "w" * 49 + "…"
    assert one(spark, T.slug(F.col("t")), t="New: corpus!") == "New__corpus" and one(spark, T.slug(F.col("t")), t="!!") == "corpus"
    text = "a" * 100 + " Needle " + "b" * 100
    assert one(spark, T.snippet(F.col("t"), "needle"), t=text) == "…" + "a" * 79 + " Needle " + "b" * 79 + "…"
    assert one(spark, T.snippet(F.col("t"), "x"), t="x") == "x"


@pytest.mark.parametrize("best, strong, docs, kw, out", [(0.6, 2, 2, 0, "covered"), (0.6, 1, 1, 3, "covered"), (0.6, 1, 1, 0, "partial"), (0.1, 0, 0, 2, "partial"), (0.1, 0, 0, 1, "gap")])
def test_verdict(spark, best, strong, docs, kw, out):
    assert spark.range(1).select(T.verdict(F.lit(best), F.lit(strong), F.lit(docs), F.lit(kw))).first()[0] == out
