"""The texts that near-dedup asks for come by broadcast; no text is shuffled by id."""

from pyspark.sql import functions as F

from beatframe.llm import near_dedup as nd


def test_no_text_is_shuffled_by_id(spark, monkeypatch):
    plans, stored = {}, nd.stage
    monkeypatch.setattr(nd, "stage", lambda d, name, *a: plans.update({name: d._jdf.queryExecution().executedPlan().toString()}) or stored(d, name, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.col("id") % 5), F.lit(1000)))))
        docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" end"), F.col("id")).alias("text"))
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i % 5 for i in range(20)}
    assert "doc_id" in plans["sets"] and "hashpartitioning(coalesce(doc_id" not in plans["sets"]


def test_pieces_equal_one_join(spark):
    docs = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (None, 7, "c"), (3, 8, "d"), (3, 9, "e")], "doc_id bigint, th bigint, text string")
    asked = spark.createDataFrame([(1, 7, "n1"), (None, 7, "n2"), (3, 9, "n3"), (3, 8, "n4"), (5, 5, "n5")], "rep_id bigint, rep_th bigint, node string")
    want = [("n1", "a"), ("n2", "c"), ("n3", "e"), ("n4", "d")]
    for most, pieces in ((100, 8), (2, 8), (1, 2)):
        assert sorted(tuple(r) for r in nd.fetch_texts(docs, asked, 5, most, pieces).select("node", "text").collect()) == want
