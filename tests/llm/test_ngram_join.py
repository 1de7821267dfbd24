import random

import numpy as np
import pytest

from gridtrace.llm import ngram_join as N

BIG = 1 << 60


def brute(rows, rule):
    """Shingle counts and least reachable ids, by comparing all pairs."""
    import re

    def shingle_set(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = rule.width
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if rule.den * c >= rule.num * (len(sets[i]) + len(sets[j]) - c):
                    a, b = root(i), root(j)
                    links[i] += 1
                    links[j] += 1
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), links[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, rule, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    out = N.near_duplicates(df, rule, **options).select("doc_id", "n_shingles", "n_links", "component_id").collect()
    return sorted((tuple(r) for r in out), key=str)


def corpus(seed, n=160):
    """Unlike texts, near copies by a few edits, exact copies and a shared passage."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=30)
    rows = []
    base = r.choices(words, k=90)
    for i in range(n):
        kind = r.random()
        if kind < 0.3:
            t = r.choices(words, k=r.randrange(1, 80))
        elif kind < 0.5:
            t = r.choices(words, k=r.randrange(1, 40)) + passage
        elif kind < 0.9:
            t = list(base)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = rows[r.randrange(len(rows))][1].split() if rows else base
        rows.append((BIG + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("rule", [N.Rule(3, 90, 100), N.Rule(5, 80, 100)])
@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"group_texts": 5, "salt_texts": 3}), (3, {"group_tokens": 300}), (4, {"most_keys": 0, "group_texts": 40})])
def test_as_by_all_pairs(spark, rule, seed, options):
    rows = corpus(seed)
    assert got(spark, rows, rule, **options) == brute(rows, rule)


def test_odd_rows(spark):
    rule = N.Rule(3, 90, 100)
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (5, "A b\x0bc D"), (6, "a b"), (7, "a B"), (8, "é b"), (9, long), (10, long + " end"), (9, long), (11, "a b c d"), (None, None), (None, "lonely text with null id")]
    assert got(spark, rows, rule) == brute(rows, rule)
    assert got(spark, [], rule) == []


def test_keeps_one_of_each_group_with_all_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (3, "", "z"), (4, "", "z"), (5, "q r s t u v", None), (5, "q r s t u v", None), (None, None, "n")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, root int")
    for broadcast_rows in (0, 1000):
        kept = N.keep_one(df, broadcast_rows=broadcast_rows)
        assert kept.columns == df.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, None]


def test_query_against_all_pairs(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op1_ngram_jaccard_join

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op1_ngram_jaccard_join(spark, SF_SMALL).collect()), key=str) == brute(rows, N.Rule(3, 90, 100))


def test_union_bound_never_loses_a_member():
    rule, rng = N.Rule(5, 80, 100), np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    members = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(40)]
    index = N.Index(np.arange(40), np.ones(40, dtype=np.int64), members)
    assert len(index.dense)
    for q, found in zip(members, index.linked(members, rule), strict=True):
        want = [i for i, s in enumerate(members) if rule.links(len(np.intersect1d(q, s)), len(q), len(s))]
        assert found.tolist() == want


def test_near_copies_of_one_text_are_cut_to_groups(spark):
    """5000 near copies, all of one bucket: no group holds more than it may, and every link is counted."""
    rule, cap = N.Rule(3, 90, 100), 384
    base = " ".join(f"c{i}" for i in range(120))
    df = spark.createDataFrame([(i, f"{base} own{i}") for i in range(5000)], "doc_id long, text string").repartition(8)  # each pair shares 118 of 120 shingles
    out = N.near_duplicates(df, rule, group_texts=cap).select("n_links", "component_id").distinct().collect()
    assert [tuple(r) for r in out] == [(4999, 0)]
    prefixes = spark.range(5000).selectExpr("xxhash64(id) AS node", "120L AS n", "7L AS bucket", "array(id) AS prefix")
    sizes = [r["count"] for r in N._grouped(prefixes, cap, 1 << 20).groupBy("grp").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= cap
    tokens = [r.s for r in N._grouped(prefixes, 1 << 20, 60_000).groupBy("grp").agg({"n": "sum"}).toDF("grp", "s").collect()]
    assert sum(tokens) == 600_000 and max(tokens) <= 60_000
