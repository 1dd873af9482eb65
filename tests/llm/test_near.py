import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm.components import components
from beatframe.llm.near_dedup import near_duplicates, shingle_sets, sketches, most_different


def family(r, base, n, rate):
    return [" ".join(r.choice(["x", "y", "zz", "Q"]) + str(r.randint(0, 99)) if r.random() < rate else w for w in base) for _ in range(n)]


def corpus(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([20, 60, 200]))]
        texts += family(r, base, r.randint(1, 8), r.choice([0.01, 0.03, 0.05]))
    base = [f"v{k}" for k in range(150)]
    texts += family(r, base, 90, 0.018) + family(r, base, 20, 0.1) + [" ".join(base)] * 40
    texts += ["a", "A", "a b", "a b", "a b c", "A B C", "", None, " \n\t", "a a a a a a", "a a a"]
    r.shuffle(texts)
    return [(k * 3 - 50, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "only here twice"), (None, "only here  twice"), (7, texts[1]), (7, texts[2]), (7, texts[2])]


@pytest.mark.parametrize("block_rows,seed", [(4096, 1), (16, 2)])
def test_near_matches_brute_force(spark, block_rows, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("n")).withColumn("label", F.lit(0)).repartition(4)
    got = near_duplicates(df, block_rows=block_rows, part_rows=600, heavy=20).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(brute.near(docs, 3, 85), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()) == [(1, 1, True), (2, 2, True), (3, 3, True)]


def test_sketches_let_similar_sets_through():
    g = np.random.default_rng(0)
    limit, missed, bands = most_different(0.85, 5.0), 0, 0
    for _ in range(300):
        n = int(g.integers(30, 3000))
        inter = int(np.ceil(0.85 * n))
        x = np.sort(g.integers(0, 2 ** 63, n).astype(np.uint64))
        cut = (n - inter) // 2
        a, b = x[cut:], x[:n - ((n - inter) - cut)]
        _, bd, sk = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        missed += int(np.bitwise_count(sk[0] ^ sk[1]).sum() > limit)
        bands += int(not (bd[0] == bd[1]).any())
    assert missed == 0 and bands == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(500, 500 + k) for k in range(1, 300)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(150)]
    up = {}

    def root(k):
        while up.setdefault(k, k) != k:
            k = up[k]
        return k
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {k: root(k) for k in {x for e in edges if e[0] != e[1] for x in e}}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x.node: x.label for x in components(df, heavy=10).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    near = [[" ".join(f"{g}{k}" for k in range(200)) + f" end{n}" for n in range(4)] for g in "abc"]
    docs = [(None, t) for t in near[0]] + [(None, near[0][0])] + [(5, t) for t in near[1]] + [(9, near[1][0])] + [(2, near[2][0])] * 2 + [(None, near[2][1])]
    docs += [(11, "alone"), (12, ""), (None, "!"), (None, None), (13, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")  # the stage reads the whole texts
    got = [tuple(r) for r in corpus_pipeline.drop_near(spark, df, str(tmp_path)).collect()]
    assert set(got) <= set(docs) and len(got) == 8
    for texts, i in zip(near, (None, 5, 2)):
        assert [d for d, t in got if t in texts] == [i]
    assert sorted(map(repr, (r for r in got if r[1] not in sum(near, [])))) == sorted(map(repr, docs[-5:]))


def test_no_fragment_of_a_near_copy_is_left(spark, tmp_path):
    """Copies that line dedup cuts down to their changed lines go; clean documents, shared passages and first copies stay."""
    r = random.Random(9)

    def lines(n):
        return [" ".join("w%d" % r.randint(0, 4000) for _ in range(14)) for _ in range(n)]
    docs, copies = [], []
    for k in range(12):
        body = lines(12)
        docs.append((k, "\n".join(body)))
        body[r.randint(0, 11)] = lines(1)[0]  # one changed line of twelve: still a near copy
        copies.append((100 + k, "\n".join(body)))
    passage = "\n".join(lines(3))
    clean = [(200 + k, "\n".join(lines(6)) + "\n" + passage) for k in range(8)] + [(300, None), (301, "")]
    df = spark.createDataFrame(docs + copies + clean, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.drop_lines(spark, df, str(tmp_path))
    cut.write.parquet(f"{tmp_path}/cut")
    cut = spark.read.parquet(f"{tmp_path}/cut")
    assert cut.where("doc_id BETWEEN 100 AND 199").count() == 12  # the changed lines are left
    got = {x.doc_id for x in corpus_pipeline.drop_near(spark, cut, str(tmp_path)).collect()}
    assert got == {i for i, _ in docs + clean}


def test_components_in_one_task(spark):
    """Paths, stars, loops and repeated edges: one task gives the labels of the rounds of joins."""
    from beatframe.llm.components import components

    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randint(200, 400), r.randint(200, 400)) for _ in range(150)]
    edges += edges[:20] + [(7, 7)]
    name = lambda i: (i * 7919 % 65536).to_bytes(2, "big") + b"\0"
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary").repartition(3)
    by_rounds, by_task = ({(bytes(x.node), bytes(x.label)) for x in components(df, one_task=n).collect()} for n in (0, 1000))
    assert by_rounds == by_task and len(by_task) == len({n for n, _ in by_task}) > 200
    assert components(df.limit(0), one_task=10).isEmpty()
