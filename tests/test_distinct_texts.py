"""Equal texts are scored once for all their items; row annotation reads each input once."""

from pyspark.sql import functions as F

from shelfwright.functions import location as L
from shelfwright.operators import text_match as TM


def test_items_are_not_split(spark):
    items = spark.createDataFrame([(s, p, "b", "dairy", t) for s, p, t in [(1, 1, "red bolt"), (1, 2, "milk rod"), (2, 1, "red bolt"), (2, 1, "red bolt"), (3, 1, "none"), (4, 1, None)]], "scan_id long, pos long, brand string, aisle string, text string")
    keywords = spark.createDataFrame([("tools", "bolt"), ("tools", "rod"), ("art", "red"), ("dairy", "milk")], "class_id string, word string")
    out = TM.foreign_class(items, keywords)
    assert sorted(map(tuple, out.collect())) == [(1, 1, "art"), (1, 2, "tools"), (2, 1, "art")]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # only distinct texts were split, before


def test_labels_and_wildcards(spark):
    texts = ["", "A-1", "A-?", "A-12", "A-1?", "?-1", "B-1", "??"]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "x string, y string")
    for r in df.select("x", "y", L.fits(F.col("x"), F.col("y")).alias("f"), L.compatible(F.col("x"), F.col("y")).alias("c")).collect():
        same = len(r.x) == len(r.y)
        assert r.f == (bool(r.x) and same and all(a in ("?", b) for a, b in zip(r.x, r.y, strict=True)))
        assert r.c == (same and all(a == b or "?" in (a, b) for a, b in zip(r.x, r.y, strict=True)))
    for text, want in [(None, ""), (" a - 1 ", "A-1"), ("a -1\t2", "A-12"), ("N/A", ""), ("a-1", "A-1"), ("not visible", "")]:
        assert spark.createDataFrame([(text,)], "x string").select(L.normalize_label(F.col("x"))).first()[0] == want
