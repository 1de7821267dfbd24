import math
import re
import zlib

import numpy as np

from gridtrace.llm import toxicity as X


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = X.Trees().fit(x[:2000], y[:2000])
    margin = m.margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    knots, p = X.isotonic(margin, y[2000:])
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] < p[-1] < 1


def test_features_see_obfuscation():
    look = X.Lookup({})
    f = dict(zip(X.NAMES, X.features("You are an 1d1ot and a m*o*r*o*n!!! YOU STUPID i d i o t", look), strict=True))
    assert f["hidden_hits"] >= 2 and f["near"] > 0 and f["runs"] > 0 and f["shouted"] > 0 and f["spaced"] > 0
    assert len(X.features("", look)) == len(X.NAMES)


def test_a_full_lookup_changes_nothing(monkeypatch):
    texts = [f"w{i} idiot w{i + 1} you scum w{i + 2}" for i in range(50)]
    want = [X.features(t, X.Lookup({"w3": 2.0})) for t in texts]
    monkeypatch.setattr(X.Lookup, "MOST", 3)
    look = X.Lookup({"w3": 2.0})
    assert [X.features(t, look) for t in texts] == want


def make(spark, n=600):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = list(rng.choice(words, 60)) + (list(rng.choice(["grunkelig", "grunkelen", "idiot", "scum"], 4)) if toxic else [])
        rng.shuffle(w)
        docs.append((i, " ".join(w), "en", 1.0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, x double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_from_the_sample_only_and_scores_all(spark):
    docs, labels = make(spark)
    model = X.train(docs, labels)
    assert any(e.startswith("grun") for e in model.lexicon)
    got = X.score(docs, model).join(labels, "doc_id").where(X.is_held_out()).collect()
    assert len(got) > 50 and np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.97
    flipped = labels.withColumn("toxic", X.F.when(X.is_held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    again = X.train(docs, flipped)
    assert again.lexicon == model.lexicon  # held-out labels are never seen


def test_odd_rows(spark):
    docs, labels = make(spark)
    model = X.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "idiot scum " * 50_000, 3), (3, "w1 w2", 3), (3, "w1 w2", 3)], "doc_id long, text string, predicted int")
    got = X.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] < 0.5 < by[None]
    assert X.score(odd.limit(0), model).collect() == []
    none = X.train(docs, labels.limit(0))
    assert none.trees is None and len(X.score(odd, none).collect()) == 5
    one = X.train(docs, labels.withColumn("toxic", X.F.lit(0)))
    assert one.trees is None
    nulls = labels.withColumn("toxic", X.F.when(X.F.col("doc_id") % 2 == 0, X.F.col("toxic")))
    assert X.train(docs, nulls).trees is not None


def test_query_held_out_accuracy(spark):
    from gridtrace.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if not r.toxic]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.01


def plain_margin(trees, x):
    """One row's margin, node by node."""
    out = trees.base
    for feat, cut, leaf in trees.trees:
        node = 0
        for level in range(trees.depth):
            at = 2**level - 1 + node
            j = int(feat[at])
            node = 2 * node + (sum(e < x[j] for e in trees.edges[j]) > cut[at])
        out += leaf[node]
    return out


def plain_curve(knots, m):
    """The calibrated probability: straight lines between the knots."""
    xs, ps = knots
    if m <= xs[0]:
        return ps[0]
    for a, b, p, q in zip(xs, xs[1:], ps, ps[1:], strict=False):
        if m <= b:
            return p + (q - p) * (m - a) / (b - a)
    return ps[-1]


def test_model_and_scores_against_brute_force(spark):
    docs, labels = make(spark, 300)
    labels = labels.withColumn("toxic", X.F.expr("IF(doc_id % 11 = 3, 1 - toxic, toxic)"))  # so that scores are many
    model = X.train(docs, labels)
    learned = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    counts, rows = {}, [0, 0]
    for r in docs.collect():
        if r.doc_id in learned:
            rows[learned[r.doc_id]] += 1
            words = set(r.text.split())
            for e in words | {w[:n] + "*" for w in words for n in (4, 5, 6, 7) if len(w) > n}:
                counts.setdefault(e, [0, 0])[learned[r.doc_id]] += 1
    odds = {e: math.log((t + 0.5) / (rows[1] + 1)) - math.log((c + 0.5) / (rows[0] + 1)) for e, (c, t) in counts.items() if t >= 3}
    want = {e: o for e, o in odds.items() if o > 1.6}
    assert want and model.lexicon.keys() == want.keys() and all(abs(model.lexicon[e] - o) < 1e-9 for e, o in want.items())
    look = X.Lookup(model.lexicon)
    got = X.score(docs, model).collect()
    assert len({r.score for r in got}) > 2
    for r in got:
        want_score = min(1.0, max(0.0, plain_curve(model.knots, plain_margin(model.trees, X.features(r.text, look)))))
        assert abs(r.score - want_score) < 1e-9


def test_isotonic_against_brute_force():
    """Pooled shares are the least over ends of the largest mean over beginnings."""
    rng = np.random.default_rng(8)
    m = np.sort(rng.standard_normal(60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * m))).astype(float)
    fit = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    groups = {}
    for k, v in enumerate(fit):
        groups.setdefault(round(v, 9), []).append(k)
    x, p = X.isotonic(m, y)
    assert np.allclose(x, [m[g].mean() for g in groups.values()])
    assert np.allclose(p, np.maximum.accumulate([(y[g].sum() + y.mean()) / (len(g) + 1) for g in groups.values()]))


def test_densities_against_brute_force():
    rng = np.random.default_rng(9)
    lexicon = {"grunk": 2.5, "blar*": 1.9, "zum": 3.0}
    vocabulary = ["grunk", "blarden", "zum", "idiot", "you", "DU", "plain", "Tree", "house!", "SKY", "why??", "a"]
    for _ in range(40):
        text = " ".join(rng.choice(vocabulary, rng.integers(1, 60)))
        words = re.findall(r"[a-z]+", text.lower())
        entry = [("grunk", 2.5) if w == "grunk" else ("blar*", 1.9) if w.startswith("blar") else ("zum", 3.0) if w == "zum" else ("idiot", 2.0) if w == "idiot" else None for w in words]
        hits, second = [i for i, e in enumerate(entry) if e], [i for i, w in enumerate(words) if w in ("you", "du")]
        per = 100 / len(words)
        want = {
            "words": math.log(1 + len(words)), "hits": min(20, len(hits)), "share": len(hits) * per, "weight": sum(entry[i][1] for i in hits) * per, "most": max((entry[i][1] for i in hits), default=0),
            "kinds": len({entry[i][0] for i in hits}), "listed": words.count("idiot") * per, "near": sum(any(abs(i - j) <= 4 for j in second) for i in hits) * per, "second": len(second) * per,
            "capitals": sum(c.isupper() for c in text) / len(text), "marks": text.count("!") * per, "questions": text.count("?") * per, "runs": text.count("??") * per,
        }
        got = dict(zip(X.NAMES, X.features(text, X.Lookup(lexicon)), strict=True))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (text, got, want)
