import numpy as np

from gridtrace.llm import embeddings as E
from gridtrace.llm.components import connected_components


def brute(rows, threshold=0.93):
    """Links and smallest reachable id by comparing all pairs of a label."""
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append(i)
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for idx in good.values():
        x = np.array([rows[i][1] for i in idx], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[idx[a]] += 1
            links[idx[b]] += 1
            parent[max(root(idx[a]), root(idx[b]))] = min(root(idx[a]), root(idx[b]))
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return {r[0]: (links[i], least[root(i)]) for i, r in enumerate(rows)}


def test_odd_rows(spark):
    a = [1.0, 0.0, 0.5]
    nan, inf = float("nan"), float("inf")
    rows = [(9, a, 1), (3, a, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (10, [nan, 1.0, 0.0], 1), (11, [inf, 1.0, 0.0], 1), (12, [None, 1.0, 0.0], 1), (13, [2.0, 0.0, 1.0], 1), (14, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert got[9] == (2, 3) and got[13] == (2, 3)
    assert E.near_duplicates(df.limit(0)).collect() == []


def test_blocks_and_repeats(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    for block in (40, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, block=block).collect()}
        assert got.keys() == want.keys()
        assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
        assert all(got[k][0] <= want[k][0] for k in want)
        assert all(k == v[1] for k, v in got.items() if v[2])


def test_no_pair_counts_twice_where_few_tables_are_in_what_is_sent(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    per_key, tables = E.plan_tables(600, 0.93, 0.9995)
    assert per_key * tables > 16
    for bits in (8, 16, 64):
        got = {r.vec_id: r.n_links for r in E.near_duplicates(df, seed_bits=bits).collect()}
        assert all(got[k] <= want[k][0] for k in want) and sum(got.values()) >= 0.99 * sum(v[0] for v in want.values())


def test_query_recall(spark):
    from conftest import SF_SMALL

    from gridtrace.llm.queries import op7_embedding_near_dedup

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op7_embedding_near_dedup(spark, SF_SMALL).collect()}
    total = sum(v[0] for v in want.values())
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.99 * total


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(7, x) for x in range(1000, 1300)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(8)
    got = dict(connected_components(df).collect())
    assert all(got[i] == 100 for i in range(100, 401)) and got[1200] == 7 and got[7] == 7 and 5 not in got
    assert connected_components(df.limit(0)).collect() == []
