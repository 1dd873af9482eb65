import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatframe.llm import personal_data as pd_ops
from beatframe.llm.personal_data import BITS, KINDS, LABELERS, VOTES, candidates, find_personal_data, joined, learn, luhn, running_sums

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_ok(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_brute(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(BASE[kind], text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                  "card": 16 <= len(d) <= 19 and luhn_ok(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def some_texts(n=300, seed=3):
    r = random.Random(seed)

    def card():
        d = "".join(r.choices("0123456789", k=15))
        return next(d + c for c in "0123456789" if luhn_ok(d + c))
    parts = [lambda: "ab.c+d%s@x-y.%s" % (r.randint(0, 99), r.choice(["com", "org", "co.uk", "zz"])), lambda: ".".join(str(r.randint(0, 300)) for _ in range(r.randint(2, 6))),
             card, lambda: " ".join([card()[i:i + 4] for i in (0, 4, 8, 12)]), lambda: "".join(r.choices("0123456789", k=r.randint(1, 25))),
             lambda: "+%d (%03d) 555-%04d" % (r.randint(0, 99), r.randint(0, 999), r.randint(0, 9999)), lambda: r.choice(["+", "@", "a@b", "a@b.", "..", "é😀", "+1", "1-", "-1 -2"]),
             lambda: "call me", lambda: "version 3.", lambda: "joe (at) site (dot) com", lambda: "a@b.c@d.e", lambda: "x (at) b.c@d.com", lambda: "ip: ", lambda: "tel ", lambda: "\n"]
    return ["".join(r.choice(parts)() + r.choice([" ", " ", "", ", ", "-"]) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_base_spans_match_brute_force(spark):
    texts = some_texts() + [None, "", "0" * 40, "1.1.1.1", "001.002.003.255", "1.2.3.256", "+1234567", "+12345678", "+1234567890123456", "a@b.c" * 3, "1.2.3.4.5.6.7.8",
                            "1 " * 3000 + "x@y.zz", "9" * 20000, "a" * 30000, "1." * 20000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x")).repartition(4)
    got = {r["doc_id"]: r for r in find_personal_data(d).withColumn("base", F.filter("spans", lambda s: s["base"])).select(
        "doc_id", joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("all"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("sha")).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_brute(t))
        assert got[i]["base"] == want, (t, got[i]["base"], want)
        assert got[i]["sha"] == hashlib.sha256(want.encode()).hexdigest()
        every = [x.split(":") for x in got[i]["all"].split(",") if x]
        assert set(want.split(",")) - {""} <= set(got[i]["all"].split(","))
        assert every == sorted(every, key=lambda x: (KINDS.index(x[0]), int(x[1])))
        for a, b in zip(every, every[1:]):
            assert a[0] != b[0] or int(a[2]) <= int(b[1])


def em_brute(votes, n, rounds):
    digits = np.array([[v // 3 ** j % 3 for j in range(VOTES)] for v in votes])
    r = 1 / (1 + np.exp(-np.clip((digits - 1.0).sum(1), -30, 30)))
    for k in range(rounds + 1):
        n1, n0 = (n * r).sum(), (n * (1 - r)).sum()
        t = np.array([[np.log(((n * r)[digits[:, j] == v].sum() + 1) / (n1 + 3)) - np.log(((n * (1 - r))[digits[:, j] == v].sum() + 1) / (n0 + 3)) for v in range(3)]
                      for j in range(VOTES)])
        prior = np.log((n1 + 1) / (n0 + 1))
        if k < rounds:
            r = 1 / (1 + np.exp(-np.clip(prior + t[np.arange(VOTES), digits].sum(1), -30, 30)))
    return r, np.concatenate([[prior], t.ravel()])


def fit_brute(bits, n, y, steps, rate=1.2, decay=1e-3):
    x = np.concatenate([np.ones((len(bits), 1)), np.array([[b >> i & 1 for i in range(BITS)] for b in bits])], axis=1)
    w = np.zeros(BITS + 1)
    for _ in range(steps):
        w = w - rate * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + decay * np.concatenate([[0], w[1:]]))
    return w


def test_learning_matches_brute_force(spark):
    g = np.random.default_rng(5)
    rows = [("ip", int(v), int(t)) for v, t in zip(g.integers(0, 3 ** VOTES, 400), g.integers(0, 64, 400))] + [("card", 3 ** VOTES - 1, 7)] * 30 + [("card", 0, 8)] * 20
    got = {r["kind"]: r for r in learn(spark.createDataFrame(rows, "kind string, votes int, traits int"), rounds=6, steps=25).collect()}
    for kind in ("ip", "card"):
        mine = [(v, t) for k, v, t in rows if k == kind]
        vs = sorted({v for v, _ in mine})
        r, ratios = em_brute(vs, np.array([sum(v == x for v, _ in mine) for x in vs], float), 6)
        assert np.allclose(got[kind]["labelers"], ratios, atol=1e-6)
        soft = dict(zip(vs, r))
        ts = sorted({t for _, t in mine})
        n = np.array([sum(t == x for _, t in mine) for x in ts], float)
        y = np.array([np.mean([soft[v] for v, t in mine if t == x]) for x in ts])
        assert np.allclose(got[kind]["weights"], fit_brute(ts, n / n.sum(), y, 25), atol=1e-6)


def test_votes_and_reliability(spark):
    assert all(len(x) == VOTES for x in LABELERS.values())
    texts = ["call +1 (234) 555-1234 now", "mail: joe@site.com", "version 4.0", "host 10.1.2.3", "4111 1111 1111 1111", "joe (at) site (dot) com"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[(c["start"], c["end"], c["base"], [c["votes"] // 3 ** j % 3 for j in range(VOTES)]) for k in KINDS for c in r[k]]
           for r in d.select(*[candidates(F.col("text"), k).alias(k) for k in KINDS]).collect()]
    assert got[0][-1] == (5, 22, True, [2, 2, 2, 2, 2, 2])
    assert got[1] == [(6, 18, True, [2, 2, 2, 2, 2, 1])]
    assert got[2] == [(8, 11, False, [0, 2, 2, 0, 2, 0])]
    assert got[3][0] == (5, 13, True, [2, 2, 2, 2, 2, 2])
    assert (0, 19, True, [2, 2, 2, 1, 2, 2]) in got[4]
    assert got[5] == [(0, 23, False, [0, 2, 2, 1, 2, 2])]


def test_wrong_check_digits_are_found_and_versions_left(spark):
    r = random.Random(7)
    texts = [f"word {''.join(r.choices('456', k=1) + r.choices('0123456789', k=15))} word" for _ in range(120)]
    texts += [f"licence version {r.randint(1, 9)}.{r.randint(0, 9)} chapter {r.randint(10, 99)}" for _ in range(200)]
    texts += [f"host {'.'.join(str(r.randint(1, 220)) for _ in range(4))} up" for _ in range(60)]
    got = [x["spans"] for x in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(any(s["kind"] == "card" and (s["start"], s["end"]) == (5, 21) for s in x) for x in got[:120])
    assert not any(got[120:320])
    assert all([(s["kind"], s["start"]) for s in x] == [("ip", 5)] for x in got[320:])


def test_nulls_repeats_and_empty_tables(spark):
    d = spark.createDataFrame([(None, "a@b.com"), (1, None), (1, ""), (2, "a@b.com"), (2, "a@b.com")], "doc_id long, text string")
    got = sorted(((r["doc_id"], len(r["spans"])) for r in find_personal_data(d).collect()), key=str)
    assert got == sorted([(None, 1), (1, 0), (1, 0), (2, 1), (2, 1)], key=str)
    assert find_personal_data(d.limit(0)).count() == 0
    assert find_personal_data(d.where("text = ''")).count() == 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 1000])
def test_running_sums(spark, n):
    x = [k % 7 for k in range(n)]
    got = spark.createDataFrame([(x,)], "x array<int>").select(running_sums(F.col("x")).alias("s")).first()["s"]
    assert got == list(np.cumsum(x)) if n else got == []


def test_luhn(spark):
    rows = [str(k) for k in range(1, 300)] + ["4111111111111111"]
    got = spark.createDataFrame([(x,) for x in rows], "d string").select("d", luhn(F.col("d")).alias("ok")).collect()
    assert all(r["ok"] == luhn_ok(r["d"]) for r in got)
    assert pd_ops.BITS == 12
