"""A line of a CSV source is parsed once, also under filters on its columns; blank and normalised texts are those of before."""

from pyspark.sql import functions as F

from shelfwright.operators import validate as V
from shelfwright.sources import tables as T


def test_filters_do_not_repeat_the_parse(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Store;Category;Sub Category;Brand;Product;Size;Facings\nA;c;s;b;p;1;2\n;c;s;b;p;1;2\n")
    good, bad = V.split_valid(T.read_planogram_csv(spark, str(tmp_path)))
    plan = good.select("location", "match_key", "expected_facings")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_csv") == 1
    assert [r.location for r in good.collect()] == ["A"] and bad.count() == 1


def test_texts_and_blanks(spark):
    values = [None, "", " ", "\t", " \n ", "a", " a  b ", "a\tb", "a \t b", "a b c", " ", "a\r\n\r\nb"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    was = F.trim(F.regexp_replace(F.coalesce("x", F.lit("")), r"\s+", " "))
    for r in df.select(was.alias("was"), V.text("x").alias("now"), V.blank("x").alias("blank")).collect():
        assert r.now == r.was and r.blank == (r.was == "")
