import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from beatframe.llm.lexical_search import search, terms
from beatframe.llm.resampling import BUCKETS, bucket_counts, crc_append, features, kth_key, ranked, resample

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def search_brute(docs, items, k):
    bags = [Counter(TERM.findall(low(t))) for _, t in docs]
    n_docs, n_terms = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        q = set(TERM.findall(low(text)))
        got = []
        for (i, _), b in zip(docs, bags):
            m = 50 + 50 * sum(b.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 20 * m)) for t in q if t in b)
            if s > 0:
                got.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(got)[:k])]
    return sorted(out, key=str)


def some_docs(r, n, words):
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(n)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "!?"), (None, docs[5][1]), docs[7], docs[7]]
    return docs + [(3000, "Ab " * 500 + "é" * 3000 + " ß")]


def test_search_matches_brute_force(spark):
    r = random.Random(1)
    words = ["ab", "Cd", "é1", "x-y", "zz!", "Ünï", "q", "ß"] + [f"w{i}" for i in range(40)]
    docs = some_docs(r, 150, words)
    items = [(i, " ".join(r.choices(words + ["none"], k=r.randint(1, 8)))) for i in range(12)] + [(50, None), (51, ""), (52, "absent"), (None, "ab q")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bag", F.lit(1)).withColumn("hash", F.lit(2)).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("m", F.lit(1))
    want = search_brute(docs, items, 10)
    assert sorted((tuple(x) for x in search(d, b, k=10).collect()), key=str) == want
    assert sorted((tuple(x) for x in search(d, b, k=10, most_items=3, most_terms=7).collect()), key=str) == want
    assert search(d.limit(0), b).count() == 0 and search(d, b.limit(0)).count() == 0


def test_terms_of_long_texts_are_not_cut():
    t = ("Abc é,1 " * 50 + "x" * 300 + " ").encode() * 3
    assert [w for part in terms(t, 37) for w in part] == re.findall(rb"[0-9a-z\x80-\xff]+", t.lower())
    assert list(terms(None)) == [] and list(terms(b"")) == []


def resample_brute(docs, target, percent=5, least=20):
    def found(t):
        w = WORD.findall(low(t))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    s, t = (Counter(b for _, x in rows for b in found(x)[1]) for rows in (docs, target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        n, f = found(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + BUCKETS) / ((s[b] + 1) * (t_all + BUCKETS)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[:len(able) * percent // 100]):
        x[4] = rank + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_resample_matches_brute_force(spark):
    r = random.Random(2)
    words = ["ab", "Cd", "é1", "x-y", "zz!", "Ünï", "q_r", "ß"] + [f"w{i}" for i in range(60)]
    docs = [x for x in some_docs(r, 300, words) if x != (7, None)] + [(4000, "y" * 5000 + " " + "ab " * 25)]
    target = [(i, " ".join(r.choices(words[:20], k=12))) for i in range(20)] + [(50, None), (51, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    b = spark.createDataFrame(target, "item_id long, text string")
    for percent in (5, 40, 100):
        got = sorted((tuple(x) for x in resample(d, b, percent=percent).collect()), key=str)
        assert got == resample_brute(docs, target, percent)
    assert resample(d.limit(0), b).count() == 0
    assert [x["rank"] for x in resample(d.limit(3), b.limit(0)).collect()] == [None] * 3


def test_features_in_blocks_and_checksums(spark):
    texts = ["Ab cd  EF", "", "x", "a b c d e", "é" * 200 + " tail", "!!"]
    want = Counter()
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        want.update((i, zlib.crc32(" ".join(w[j:j + n]).encode()) % BUCKETS) for n in (1, 2, 3) for j in range(len(w) - n + 1))
    for block, part in ((1 << 16, 1 << 22), (2, 5), (1, 1)):
        got = Counter((int(o), int(b)) for owner, bucket, _ in features(pa.array(texts), block, part) for o, b in zip(owner, bucket))
        assert got == want
    buf = np.frombuffer(b"hello" * 60, np.uint8)
    s = crc_append(np.full(1, 0xFFFFFFFF, np.uint32), buf, np.array([0]), np.array([300]))
    assert int(s[0]) ^ 0xFFFFFFFF == zlib.crc32(b"hello" * 60)
    counts = bucket_counts(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"), "text")
    assert counts.sum() == sum(want.values())


def test_kth_key_and_ranks(spark):
    n = 997
    key = F.struct((F.col("id") % 7).alias("s"), (F.col("id") % 5 == 0).alias("late"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("id"),
                   F.lit(0).cast("bigint").alias("tie"), F.col("id").alias("row"))
    keys = spark.range(n).select(key.alias("key"))
    order = [tuple(r["key"]) for r in keys.orderBy("key").collect()]
    for k in (1, 2, 500, n):
        assert kth_key(keys, k, pivots=3) == order[k - 1]
    got = {tuple(r["key"]): r["rank"] for r in ranked(keys, n, per_part=50).collect()}
    assert [got[k] for k in order] == list(range(1, n + 1))
