"""Rows told by their ids without being shuffled, against plain sets, and the plans of what uses it."""

import pytest
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm import idfilter, partenum, quality_bayes


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def parts_of(spark, frame):
    """The operators' names in each part of the plan's topmost union, planned without adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frame.select("*")._jdf.queryExecution().executedPlan()
        union = next(n for n in nodes(plan) if n.nodeName() == "Union")
        children = union.children()
        return [[n.nodeName() for n in nodes(children.apply(i))] for i in range(children.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("most", [1 << 19, 4, 1])  # with few blocks nearly all passes, and the join decides
@pytest.mark.parametrize("wanted", [lambda i: i % 7 == 0, lambda i: False, lambda i: True])
def test_ids_are_met_exactly(spark, monkeypatch, most, wanted):
    monkeypatch.setattr(idfilter, "MOST_BLOCKS", most)
    values = [(None if i % 50 == 0 else i % 900 if i > 400 else 21, f"t{i}", i, "x") for i in range(1500)]  # a key with a third of the rows, repeats and nulls
    rows = freeze(spark.createDataFrame(values, "doc_id long, text string, _hit int, `_k0` string").repartition(5))
    ids = freeze(spark.createDataFrame([(i,) for i in range(1000) if wanted(i)], "_id long"))
    known = freeze(rows.select(F.col("doc_id").alias("_id")))
    for inside in (True, False):
        found = idfilter.with_ids(rows, F.col("doc_id"), ids, known, inside)
        assert found.columns == rows.columns
        assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(v[1:] for v in values if (v[0] is not None and wanted(v[0])) == inside)
    certain, rest = parts_of(spark, found)
    assert "Exchange" not in certain and "Sort" not in certain and certain.count("BroadcastExchange") == 2
    assert rest.count("Exchange") == 2


def test_most_rows_are_certain(spark):
    ids = freeze(spark.range(0, 60_000, 3).select(F.col("id").alias("_id")))
    known = freeze(spark.range(60_000).select(F.col("id").alias("_id")))
    first = idfilter.Filter(ids, ids.count())
    passed = first.mark(known, "_id", "_hit").where("_hit").count()
    assert 20_000 <= passed < 20_000 + 40_000 / 200


def test_stages_shuffle_no_texts_beyond_the_switches(spark, monkeypatch):
    small = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    docs = docs.unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    stages = {"good": lambda: quality_bayes.keep_good(docs, labels), "copies": lambda: partenum.drop_near_copies(docs.where("doc_id is not null"))}
    few = {n: sorted(map(str, f().collect())) for n, f in stages.items()}
    monkeypatch.setattr(partenum, "BROADCAST_IDS", 0)
    monkeypatch.setattr(quality_bayes, "BROADCAST_LABELS", 0)
    for name, stage in stages.items():
        frame = stage()
        assert sorted(map(str, frame.collect())) == few[name]
        assert "Exchange" not in parts_of(spark, frame)[0]
    judged = quality_bayes.judge(docs, labels, keep=tuple(docs.columns)).where("kept").select(*docs.columns)
    assert sorted(map(str, judged.collect())) == few["good"]
