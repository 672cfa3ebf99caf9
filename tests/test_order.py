"""Global order over many tasks."""

import random

from pyspark.sql import functions as F

from lectern.operators import order, progress


def test_places_and_sums(spark):
    r = random.Random(1)
    words = r.sample([f"{a}/{b}" for a in range(80) for b in range(80)], 3000)
    rows = [(w, r.randint(0, 9) or None) for w in words]
    df = spark.createDataFrame(rows, "w string, n long")
    got = {x.w: (x.place, x.total) for x in order.before(order.before(df, ["w"], to="place", ranges=13), ["w"], F.col("n"), "total", ranges=5).collect()}
    total = 0
    for k, (w, n) in enumerate(sorted(rows, key=lambda x: x[0])):
        assert got[w] == (k, total)
        total += n or 0
    assert order.before(df.where("false"), ["w"]).count() == 0


def test_path_rank(spark):
    paths = ["b", "a/b", "a b", "a/b", "a/c", None, "a", "flat/1", "flat/2", "flat/10"]
    got = sorted((r.rel_path or "", r.place) for r in progress.path_rank(spark.createDataFrame([(p,) for p in paths], "rel_path string")).collect())
    known = sorted((p for p in paths if p), key=lambda p: p.split("/"))
    assert got == sorted((p or "", None if p is None else known.index(p) + 1) for p in paths)


def test_no_window_over_everything(spark):
    files = spark.range(1000).select(F.concat(F.lit("flat/"), F.col("id")).alias("rel_path"))
    ranked = progress.path_rank(files)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and ranked.agg(F.count_distinct("place")).head()[0] == 1000


def test_winners(spark):
    rows = [("a.docx", "1"), ("a.pdf", "2"), ("a.pdf", "3"), ("b/c.txt", "4"), (None, "5"), ("d", "6"), ("d", "6")]
    got = progress.winners(spark.createDataFrame(rows, "rel_path string, markdown string"), then=[F.col("markdown")])
    assert sorted((r.out_path, r.rel_path, r.markdown) for r in got.collect()) == [("a.md", "a.pdf", "3"), ("b/c.md", "b/c.txt", "4"), ("d.md", "d", "6")]
