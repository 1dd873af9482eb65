import random

import brute
import pytest
from pyspark.sql import functions as F

from beatframe.llm import repeats
from beatframe.llm.substring_dedup import remove_shared_words
from beatframe.llm.suffix_dedup import remove_earlier_bytes


def corpus(seed, n=60):
    r = random.Random(seed)
    voc = ["ab", "cde", "éñ", "f", "ghij", "日本"]
    base = [" ".join(r.choice(voc) for _ in range(r.randint(0, 120))) for _ in range(12)]
    docs = [(k * 7 - 100, "\n".join(r.sample(base, r.randint(1, 3)))) for k in range(n)]
    docs += [(3, None), (4, ""), (None, base[0]), (None, base[1] + " x"), (5, base[2]), (5, base[2]), (5, base[3]), (9, "z" * 3000), (10, " \t\v\n"), (11, "a  b\x0bc")]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("v", sorted(repeats.COVERS))
def test_cover_reaches_every_difference(v):
    d = repeats.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("length,period", [(100, 57), (40, 31), (30, 21)])
def test_bytes_match_brute_force(spark, monkeypatch, length, period):
    docs = corpus(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(5)
    monkeypatch.setattr(repeats, "HASH_PART", 512)
    got = remove_earlier_bytes(df, length=length, period=period, block_mb=1)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.d) for r in got.withColumn("d", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=repr) == sorted(brute.earlier_bytes(docs, length), key=repr)


def test_bytes_over_many_blocks(spark):
    docs = [(k, t) for k, (_, t) in enumerate(corpus(3, 900) * 2)]
    docs = [(k, (t or "") * 6) for k, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n, r.d) for r in remove_earlier_bytes(df, block_mb=1).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), F.sha2("kept", 256).alias("d")).collect()]
    assert sorted(got) == sorted(brute.earlier_bytes(docs, 100))
    got = [(r.doc_id, r.n_words, r.n_removed, r.d) for r in remove_shared_words(df, block_mb=1).withColumn("d", F.sha2(F.encode("kept", "UTF-8"), 256)).collect()]
    assert sorted(got) == sorted(brute.shared_words(docs, 35))


@pytest.mark.parametrize("window,period", [(35, 21), (10, 7)])
def test_words_match_brute_force(spark, window, period):
    docs = corpus(window)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("payload", F.lit(1)).repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.d) for r in remove_shared_words(df, window=window, period=period).withColumn(
        "d", F.sha2(F.encode("kept", "UTF-8"), 256)).collect()]
    assert sorted(got, key=repr) == sorted(brute.shared_words(docs, window), key=repr)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_earlier_bytes(df).count() == 0 and remove_shared_words(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in remove_shared_words(df).orderBy("doc_id").collect()] == [(1, 0, 0, ""), (2, 0, 0, "")]
