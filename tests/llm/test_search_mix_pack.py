import random
from itertools import product

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm.line_dedup import remove_repeated_lines
from beatframe.llm.mixing import closest_subset, fit_source, mix_sources
from beatframe.llm.packing import CAPACITIES, best_fit, pack_documents, sequence_cost
from beatframe.llm.vector_search import top_k_products


def top_k_brute(rows, k, scale=64):
    ok = [(i, np.floor(scale * np.array(v, dtype=float)).astype(int)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-int(q @ c), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -m) for r, (m, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e4, 1e6])  # at 1e9 scores pass 64 bits, an error below
def test_top_k(spark, spread):
    g = np.random.default_rng(1)
    rows = [(k, [float(x) for x in g.normal(size=20) * spread * g.choice([0.1, 1.0])]) for k in range(300)]
    rows += [(400 + k, rows[7][1]) for k in range(40)]
    rows += [(1, None), (500, [1.0, None]), (520, [float("nan")] * 20), (540, [float("inf")] * 20), (None, rows[0][1]), (560, []), (561, []), (580, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).repartition(3)
    got = top_k_products(df, F.col("vec_id") % 20 == 0, k=10, step=4, query_rows=5, candidate_rows=90)
    assert sorted(tuple(r) for r in got.collect()) == top_k_brute(rows, 10)
    assert top_k_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    """Products that fit are exact though sums on the way don't; those that don't fit raise, and so do wide components."""
    def search(rows):
        return top_k_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2)
    fits = [(20, [2.0 ** 29, 2.0 ** 29, 3.0]), (21, [2.0 ** 29, -(2.0 ** 29), 1.0]), (22, [2.0 ** 18, 2.0 ** 17, 2.0]), (23, [-(2.0 ** 18), 1.0, 2.0])]
    assert sorted(tuple(r) for r in search(fits).collect()) == top_k_brute(fits, 2)
    for x in (2.0 ** 29, 1e18):
        with pytest.raises(Exception, match="64 bits"):
            search([(20, [x, 1.0]), (21, [x, 2.0])]).collect()


def test_closest_subset_matches_enumeration():
    r = random.Random(4)
    for _ in range(60):
        lengths = r.sample(range(1, 30), 4)
        counts = [r.randint(0, 3) for _ in lengths]
        budget = r.randint(0, 70)
        take = closest_subset(lengths, counts, budget, 30)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        best = min(abs(sum(a * b for a, b in zip(lengths, x)) - budget) for x in product(*[range(c + 1) for c in counts]))
        assert abs(sum(a * b for a, b in zip(lengths, take)) - budget) == best


def test_fit_source_hits_the_budget():
    g = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(g.choice(5000, 300, replace=False))
        counts = g.integers(1, 50, 300)
        size = int((lengths * counts).sum())
        target = float(g.uniform(0, 3) * size)
        base, extra = fit_source(lengths, counts, target, 3, 0)
        assert abs((lengths * (base * counts + extra)).sum() - target) <= 1 and (extra <= counts).all() and (extra >= 0).all()


def mix_docs(seed=0):
    r = random.Random(seed)
    docs = [(k, r.choice(["b", "a", "c", None, "é"]) if k % 3 else "a", " ".join(["w"] * r.choice([5, 17, 100, r.randint(0, 400)]))) for k in range(900)]
    return docs + [(5000, "zero", ""), (5001, "zero", None), (None, "a", "x y"), (3, "a", "x y z"), (3, "a", "x y z")]


def test_mixing(spark):
    docs = mix_docs()
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("part", F.lit(1)).repartition(4)
    got = mix_sources(df, parts=8).select("row.*", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        rows = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in rows)
        assert abs(sum(r["size"] * r.copies for r in rows) - target[s]) <= 5
    assert all(0 <= r.copies <= 3 for r in got)
    again = mix_sources(df.repartition(7), parts=8).select("row.*", "size", "source_size", "target", "copies").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mix_sources(df.limit(0)).count() == 0


def best_fit_brute(lengths, capacities, cost):
    bins, where, left, touched = [], [], sum(lengths), {}
    for size in lengths:
        fits = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= size]
        if fits:
            room = min(f[0] for f in fits)
            k = max((k for r, k in fits if r == room), key=lambda k: touched[k])
        else:
            c = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / min(c, left), c))
            k = len(bins)
            bins.append((c, 0))
        bins[k] = (bins[k][0], bins[k][1] + size)
        touched[k] = len(where)
        where.append(k)
        left -= size
    return where, [u for _, u in bins]


def test_best_fit_matches_plain_search():
    r = random.Random(3)
    for _ in range(20):
        lengths = sorted((r.randint(1, 300) for _ in range(200)), reverse=True)
        where, offsets, final = best_fit(lengths, (64, 100, 300), sequence_cost)
        want, used = best_fit_brute(lengths, (64, 100, 300), sequence_cost)
        assert where == want
        assert final == [min(c for c in (64, 100, 300) if c >= u) for u in used]


def test_packing_keeps_every_word(spark):
    docs = [(d, t) for d, _, t in mix_docs(1)] + [(9000, " ".join(["q"] * 20000)), (9001, " \n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit(2)).repartition(3)
    got = pack_documents(df, shard_words=30_000).collect()
    words = {}
    for d, t in docs:
        words[d] = words.get(d, 0) + len((t or "").split())
    bins = {}
    for r in got:
        words[r.doc_id] -= r.length
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None
    assert not any(words.values())
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        used = sum(r.length for r in rows)
        assert all(r.used == used and r.capacity == min(c for c in CAPACITIES if c >= used) for r in rows)
    assert sum(rows[0].capacity for rows in bins.values()) < 1.1 * sum(r.length for r in got)
    assert pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines(spark, run):
    r = random.Random(run)
    pool = [f"line {k}" for k in range(25)] + ["", " \t"]
    docs = [(k - 20, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9)))) for k in range(150)]
    docs += [(500, "same\n" * 30), (None, docs[0][1]), (501, None), (502, ""), (503, "\n\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in remove_repeated_lines(df, run=run, heavy=50).select("row.*", "n_lines", "n_removed").collect()}
    assert got == brute.repeated_lines(docs, run)
    assert remove_repeated_lines(df.limit(0), run=run).count() == 0


def test_lines_repeated_rows(spark):
    docs = [(1, "a\nb"), (1, "a\nb"), (1, "a\nb\nc"), (2, "a\nb")]
    got = remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("row.*").collect()
    assert sorted(tuple(x) for x in got) in ([(1, "a\nb"), (1, "a\nb"), (1, "c"), (2, "")], [(1, ""), (1, ""), (1, "a\nb\nc"), (2, "")])


def test_long_lines_alone(spark, tmp_path):
    r = random.Random(9)
    pool = [" ".join(f"w{k}" for k in range(a, a + r.choice([1, 3, 4, 5, 9]))) for a in range(40)] + ["", " \t"]
    docs = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for k in range(120)]
    docs += [(500, "\n".join([pool[0] + " a b c d"] * 4)), (None, pool[0] + " a b c d"), (501, None), (502, "")]
    want, seen = {}, set()
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone = {k for k in at if len(lines[k].split()) >= 4 and (lines[k] in seen or lines[k] in lines[:k])}
        seen.update(x for x in lines if len(x.split()) >= 4)
        want[i] = (lines, at, gone)
    pairs = set()
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        lines, at, gone = want[i]
        for a, b in zip(at, at[1:]):
            if (lines[a], lines[b]) in pairs:
                gone |= {a, b}
            pairs.add((lines[a], lines[b]))
        want[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(at), len(gone))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in remove_repeated_lines(df, heavy=50, alone=4).select("row.*", "n_lines", "n_removed").collect()}
    assert got == want
    line = " ".join(f"license{k}" for k in range(12))
    docs = [(k, f"before {k}\n{line}\nafter {k}") for k in range(3)] + [(3, line), (4, "x\nshort line"), (5, "y\nshort line")]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(tuple(x) for x in got) == [(0, docs[0][1]), (1, "before 1\nafter 1"), (2, "before 2\nafter 2"), (4, docs[4][1]), (5, docs[5][1])]
