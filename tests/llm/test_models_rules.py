import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from beatframe.llm.conv import chunk_places, draw, forward, gradients, softmax, start
from beatframe.llm.language_id import language, learn_languages
from beatframe.llm.quality_classifier import learn_quality, quality_score
from beatframe.llm.quality_rules import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_gradients_match_differences():
    p = start(3, (2, 3), 4, 3, 5, 2, 1)
    p = {k: v.astype(np.float64) if isinstance(v, np.ndarray) else v for k, v in p.items()}
    g = np.random.default_rng(0)
    x, y = g.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    grad, _ = gradients(x, y, p)

    def loss(q):
        return -np.log(softmax(forward(x, q)[0])[np.arange(6), y] + 1e-9).mean()
    for name in ("filters", "dense", "out", "embed", "bias"):
        for flat in g.choice(p[name].size, min(20, p[name].size), replace=False):
            at = np.unravel_index(flat, p[name].shape)
            if name == "filters" and not p["mask"][at]:
                assert grad[name][at] == 0
                continue
            up, down = ({**p, name: p[name].copy()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[name][at]) < 1e-4


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        doc, begin = chunk_places(np.array([n]), 512, 448)
        seen = np.zeros(n, bool)
        for b in begin:
            seen[b:b + 512] = True
        assert seen.all() and len(doc) >= 1


def small_docs():
    g = np.random.default_rng(3)
    en, de = ["the", "and", "then", "other", "thing"], ["und", "für", "über", "schön", "nicht"]
    docs = []
    for k in range(160):
        w = g.choice(en if k % 2 else de, 80)
        bad = k % 4 >= 2
        docs.append((k, " ".join(w[0] if bad else x for x in w), "en" if k % 2 else "de", None if k % 9 == 0 else "s", int(not bad)))
    return docs


def test_learned_models(spark):
    docs = spark.createDataFrame(small_docs() + [(900, None, "de", "s", 1), (901, "", None, "s", 1), (None, "12 34", "en", None, 0), (902, "und " * 9000, "de", "s", 0)],
                                 "doc_id long, text string, lang string, source string, quality int").withColumn("score", F.lit(1))
    params = learn_quality(docs, docs.where("doc_id IS NOT NULL").select("doc_id", "quality"), steps=120)
    rows = docs.select("doc_id", "quality", quality_score(F.col("text"), params).alias("p")).collect()
    assert all(0 <= r.p <= 1 for r in rows)
    assert np.mean([(r.p >= 0.5) == r.quality for r in rows]) > 0.9
    params, names = learn_languages(docs, steps=60)
    got = {r.doc_id: (r.lang, r.p) for r in docs.select("doc_id", "lang", language(F.col("text"), params, names).alias("p")).collect()}
    assert got[900][1].lang_pred == got[901][1].lang_pred == got[None][1].lang_pred == "und" and names == ["de", "en"]
    assert np.mean([p.lang_pred == lang for k, (lang, p) in got.items() if k is not None and k < 900]) > 0.95
    none = docs.limit(0)
    assert none.select(quality_score(F.col("text"), learn_quality(none, none))).count() == 0
    params, names = learn_languages(none)
    assert docs.select(language(F.col("text"), params, names).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def test_sample_is_bounded_by_rows(spark):
    """Every class keeps rows while there are at most ``most`` classes; the whole sample stays near ``most`` rows."""
    rows = spark.range(30_000).select(F.when(F.col("id") < 10_000, F.lit("hot")).when(F.col("id") < 28_000, F.concat(F.lit("c"), F.col("id") % 1500)).alias("y"), "id")
    drawn, counts = draw(rows, 500)
    assert drawn.columns == ["y", "id"] and counts.count() == 1501
    n = {r.y: r["count"] for r in drawn.groupBy("y").count().collect()}
    assert len(n) == 1501 and None not in n and 500 < n["hot"] < 700 and all(n[f"c{k}"] == 12 for k in range(1500))
    n = {r.y: r["count"] for r in draw(rows, 500, most=6_000)[0].groupBy("y").count().collect()}
    assert len(n) == 1501 and 3_000 < sum(n.values()) < 6_600 and n["hot"] < 20
    few = draw(rows, 500, most=300)[0]
    assert 150 < few.select("y").distinct().count() < 450 and few.count() < 600
    assert draw(rows.limit(0), 500)[0].count() == 0
    one = draw(rows.where("y = 'hot'"), 500)[0].agg(F.count("id"), F.countDistinct("id")).first()
    assert one[0] == one[1] == draw(rows, 500)[0].where("y = 'hot'").count()


def base_brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k:k + 5]), []).append(k)
    hit = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    g = np.random.default_rng(1)
    voc = [f"w{k}é" for k in range(300)]
    docs = [(k, "\n".join(" ".join(g.choice(voc, 12)) for _ in range(int(g.integers(3, 9)))), "en", None if k % 2 else "s") for k in range(300)]
    docs += [(1000 + k, " ".join(x + "%%%" for x in g.choice(voc, 60)), "en", "s") for k in range(5)]
    docs += [(2000, "a b c d e " * 20, "en", "s"), (2001, None, None, None), (2002, "", "en", "s"), (2003, "\n".join(["a b c d e f g h i j k"] * 2 + [" ".join(voc)] + ["x"] * 9), "fr", "s"),
             (2004, "x y a b c d e x a b c d e f", "xx", "s"), (None, "\t\x0b\n", "en", "s")]
    got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("key", F.lit(1)).repartition(3)).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, t, _, _ in docs:
        r, want = by[i], base_brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert all(by[k].kept for k in range(300)) and not any(by[1000 + k].kept for k in range(5))


def test_rules_judge_small_groups(spark):
    g = np.random.default_rng(5)
    voc = [f"w{k}" for k in range(300)]

    def text(mark=""):
        return "\n".join(" ".join(x + mark for x in g.choice(voc, 12)) for _ in range(5))
    kind = "doc_id long, text string, lang string, source string"
    docs = [(k, text(), "en", f"s{k % 10}") for k in range(100)] + [(200 + k, text(), "fr", None) for k in range(8)] + [(300, text(), None, "s1")]
    docs += [(1000, text("%%%"), "en", "s3"), (1001, text("%%%"), "en", "new"), (1002, text("%%%"), "fr", "s1"), (1003, text("%%%"), None, None), (1004, None, "de", "s1")]
    for rows in (docs, [d for d in docs if d[0] >= 1000 or d[0] < 30]):
        for most in (20_000, 2):
            got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, kind).repartition(3), most_groups=most).collect()}
            assert len(got) == len(rows) and all(r.distance2 is not None for r in got.values())
            assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002, 1003, 1004}
    got = quality_rules(spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "fr", "s")], kind)).collect()
    assert len(got) == 2 and not any(r.kept for r in got)
    assert quality_rules(spark.createDataFrame([], kind)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = small_docs()
    shared = "\n".join(["license line one", "license line two"])
    texts = [(i, t.replace(" ", "\n", 3) + ("\n" + shared if i % 5 == 0 else ""), lang, s, len(t)) for i, t, lang, s, _ in docs] + [(700, None, "de", "s", 0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[4], 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    t = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = t.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, t, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, t = t, spark.read.parquet(f"{tmp_path}/{k}")
        assert t.columns == names or k == 4
        if k == 0:
            bad = {d[0] for d in docs if not d[4]}
            assert sum(r.doc_id in bad for r in t.collect()) < 8 and t.count() > 60
        if k == 1:
            assert sum(shared in r.text for r in t.collect()) == 1
        if k == 2:
            assert t.select("doc_id").distinct().count() == t.count() <= before.count()
    words = {}
    for r in before.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    for r in t.collect():
        words[r.doc_id] -= r.length
    assert not any(words.values())
