"""Helpers: stable row numbers, and columns picked by exact name."""

from pyspark.sql import functions as F

from tensorloom.llm import common


def test_numbers_stay_the_same(spark, folder):
    scan = common.numbered(common.documents(spark, folder).select("doc_id", "text"))
    assert not any("numbered" in f for f in scan.inputFiles())
    one = {(r.row, r.text) for r in scan.select("row", "text").collect()}
    assert one == {(r.row, r.text) for r in scan.collect()} and len({n for n, _ in one}) == len(one)
    dealt = common.numbered(common.documents(spark, folder).select("doc_id", "text").repartition(5))
    assert all("numbered" in f for f in dealt.inputFiles())
    assert sorted(map(tuple, dealt.collect()), key=repr) == sorted(map(tuple, dealt.collect()), key=repr)


def test_pick_takes_the_exact_name(spark):
    df = spark.createDataFrame([(1, "small", "LARGE")], "id long, text string, Text string")
    assert common.pick(df, a="text", b="Text").first() == ("small", "LARGE")


def test_few_is_broadcast_only_if_counted_small(spark, monkeypatch):
    ids = spark.range(10)
    plan = lambda df: spark.range(5).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(common.few(ids)).lower()
    monkeypatch.setattr(common, "FEW", 3)
    assert "broadcast" not in plan(common.few(ids)).lower()
