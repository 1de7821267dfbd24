import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrace.functions import kernels as K
from gridtrace.functions.interp import lerp, lerp_join
from gridtrace.operators import kdtree, seeds
from gridtrace.operators import trace as T
from gridtrace.plans.grid import Grid
from gridtrace.sources import fields


def array_of(size, f):
    at = np.meshgrid(*(np.arange(s) for s in reversed(size)), indexing="ij")[::-1]
    return np.stack([np.broadcast_to(v, size[::-1]) for v in f(*at)]).astype(np.float64)


@pytest.mark.parametrize("size", [(9, 7), (6, 5, 4), (5, 4, 4, 3)])
def test_multilinear_fields_are_exact(size):
    data = array_of(size, lambda *p: (1 + sum((k + 2) * x for k, x in enumerate(p)), np.prod(np.array(np.broadcast_arrays(*p)), axis=0)))
    rng = np.random.default_rng(0)
    p = rng.random((200, len(size))) * (np.array(size) - 1)
    v, ok = lerp(p, data, np.zeros(len(size)))
    assert ok.all() and np.allclose(v[:, 0], 1 + p @ np.arange(2, 2 + len(size))) and np.allclose(v[:, 1], p.prod(axis=1))
    out = np.array([[-0.1] + [0.5] * (len(size) - 1), [size[0] - 1.0] + [0.5] * (len(size) - 1), [np.nan] * len(size)])
    assert not lerp(out, data, np.zeros(len(size)))[1].any()


def test_closed_forms_of_half_steps():
    size, h, n = (64, 64), 0.2, 25
    dom = np.array(size)
    go = lambda f, x: K.advance(K.KERNELS["rk1_2d"], K.Brick.whole(array_of(size, f)), np.array([x]), np.zeros(1, int), h, n, n, dom)
    x, s, *_ = go(lambda x, y: (0 * x + 2.0, 0 * x - 1.0), [10.0, 40.0])
    assert s[0] == n and np.allclose(x, [[10 + 0.5 * h * n * 2, 40 - 0.5 * h * n]])
    x, s, done, st, work, *_ = go(lambda x, y: (0.0 * x, 0.0 * x), [10.0, 40.0])
    assert (s[0], done[0], st[0], work[0]) == (0, True, K.CRITICAL_POINT, 1)
    x, *_ = go(lambda x, y: (0.1 * y, 0.0 * x), [5.0, 20.0])
    assert np.allclose(x, [[5 + 0.5 * h * n * 0.1 * 20, 20]])
    x, *_ = go(lambda x, y: (0.1 * (x - 31.5), -0.1 * (y - 31.5)), [33.0, 40.0])
    k = 0.5 * h * 0.1
    assert np.allclose(x - 31.5, [[1.5 * (1 + k) ** n, 8.5 * (1 - k) ** n]])
    x, *_ = go(lambda x, y: (-0.3 * (y - 31.5), 0.3 * (x - 31.5)), [35.5, 31.5])
    assert np.isclose(np.hypot(*(x[0] - 31.5)), 4 * (1 + (0.5 * h * 0.3) ** 2) ** (n / 2))


def test_time_kernels():
    size = (12, 12, 12, 8)
    one = K.Brick.whole(array_of(size, lambda x, y, z, t: (0 * x + 30.0, 0.0 * x, 0.0 * x)).astype(np.float32))
    x = np.full((1, 4), 3, dtype=np.float32)
    new, st = K.KERNELS["hurricane_rk1_4d"](one, x, 450.0)
    dx = 0.5 * 450 * 30 / 3880
    assert st[0] == 0 and np.isclose(new[0, 0], 3 + dx) and np.isclose(new[0, 3], 3 + dx * 3880 / 30 / 3600)
    back, _ = K.KERNELS["hurricane_rk1_4d"](one, x, -450.0)
    assert back[0, 0] < 3 and back[0, 3] < 3
    four, st = K.KERNELS["hurricane_rk4_4d"](one, x, 450.0)
    assert st[0] == 0 and np.isclose(four[0, 0], 3 + 450 * 30 / 3880, rtol=1e-5)
    full, _ = K.KERNELS["rk1_4d"](one, x, 0.1)
    assert np.allclose(full[0], [6, 3, 3, 3.1])
    still = K.Brick.whole(np.zeros((3, 8, 12, 12, 12), dtype=np.float32))
    same, st = K.KERNELS["hurricane_rk1_4d"](still, x, 450.0)
    assert st[0] == K.NO_VALUE and (same == x).all()  # no speed, no time: no value
    gone, st = K.KERNELS["hurricane_rk4_4d"](still, x, 450.0)
    assert st[0] == K.OUT_OF_BOUND


def test_atmosphere_kernels():
    size = (288, 20, 6, 4)
    data = array_of(size, lambda x, y, z, t: (0 * x + 2.0, 0 * x + 1.0, 0.0 * x, 100.0 * (6 - z))).astype(np.float32)
    b = K.Brick.whole(data)
    x = np.array([[286.9, 5.0, 2.5, 1.0], [10.0, 5.0, 0.2, 1.0]], dtype=np.float32)
    v, ok = K.atmosphere_velocity(b, x)
    assert ok.all() and np.allclose(v, [[2, 1, 0]] * 2)
    new, st = K.KERNELS["atmosphere_rk1_4d"](b, x, 0.2, wrap=True)
    shrink = np.cos(np.radians(5.0 - 90)) + 0.01
    assert (st == 0).all() and np.isclose(new[0, 0], 286.9 + 0.2 - 287, atol=1e-4) and np.isclose(new[1, 1], 5 + 0.1 * shrink)
    assert (new[:, 3] > 1).all()
    for k in ("atmosphere_rk1_3d", "atmosphere_rk4_4d"):
        n3, st = K.KERNELS[k](K.Brick.whole(data[:, 0]) if k.endswith("3d") else b, x[:, :3] if k.endswith("3d") else x, 0.2, wrap=True)
        assert (st == 0).all() and np.isfinite(n3).all()
    assert np.isclose(K.haversine(0, 90, 287 / 4, 90), K.EARTH * np.pi / 2)


def run(spark, n_blocks, data, mode="baseline", kernel="rk1_2d", size=(33, 33), ghosts=2, **o):
    grid = Grid.of(size, n_blocks, ghosts)
    plan = T.Plan(grid, kernel, 0.9, 24, round_steps=8, mode=mode, **o)
    start = seeds.lattice(spark, (9,) * len(size), grid, exact=True)
    return grid, plan, T.trace(start, fields.bricks_from_array(spark, data, grid), plan)


def swirl(size=(33, 33)):
    return array_of(size, lambda x, y, *_: (np.sin(y / 4) + 0.2, np.cos(x / 5))).astype(np.float32)


def table(result):
    return {r.particle_id: (r.num_steps, round(float(r.x), 4), round(float(r.y), 4)) for r in result.collect()}


def test_results_do_not_depend_on_blocks_or_mode(spark):
    data = swirl()
    _, plan, one = run(spark, 1, data)
    want = table(one.particles)
    assert len(want) == 81
    for n in (2, 6):
        _, _, r = run(spark, n, data)
        assert table(r.particles) == want and r.rounds["steps"].sum() == one.rounds["steps"].sum()
    _, _, kd = run(spark, 4, data, mode="kdtree", ghosts=4)
    assert table(kd.particles) == want
    grid = Grid.of((33, 33), 1, 0)
    whole = T.trace_whole(seeds.lattice(spark, (9, 9), grid, exact=True), data, plan)
    assert table(whole) == want
    _, _, salted = run(spark, 2, data, chunk=7)
    assert table(salted.particles) == want


def test_constrained_splits_keep_particles_in_their_data(spark):
    data = swirl()
    grid, plan, r = run(spark, 8, data, mode="kdtree", ghosts=3)
    assert r.leaves and sorted(n.path for n in r.leaves) == list(range(8))
    pts = spark.range(3000).select("id", F.array((F.rand(1) * 4).alias("x"), (F.rand(2) * 31)).alias("p"))
    at, nodes = kdtree.constrained(pts, grid)
    blocks = {b["gid"]: b for b in kdtree.blocks_of_leaves(spark, kdtree.constrained(None, grid, first=True)[1], grid).collect()}
    for row in at.collect():
        b = blocks[row["node"]]
        assert all(lo <= x <= hi for x, lo, hi in zip(row["p"], b["glb"], b["gub"]))


def test_edge_cases(spark):
    data = swirl()
    grid = Grid.of((33, 33), 2, 2)
    bricks = fields.bricks_from_array(spark, data, grid)
    none = seeds.lattice(spark, (3, 3), grid).limit(0)
    r = T.trace(none, bricks, T.Plan(grid))
    assert r.particles.count() == 0 and not len(r.rounds)
    with pytest.raises(ValueError):
        kdtree.levels(6)
    with pytest.raises(RuntimeError):
        g0 = Grid.of((33, 33), 2, 0)
        T.trace(seeds.lattice(spark, (9, 9), g0, exact=True), fields.bricks_from_array(spark, data, g0), T.Plan(g0, h=0.9, max_steps=24, round_steps=8, max_rounds=6))
    with pytest.raises(ValueError):
        T.trace_whole(none, data, T.Plan(grid), most_bytes=10)


def test_three_dimensions_and_bricks_of_a_table(spark):
    size = (9, 8, 7)
    grid = Grid.of(size, 4, 1)
    f = fields.analytic(spark, "constant", size, velocity=(1.0, 0.5, 0.25))
    bricks = fields.to_bricks(f, grid, ["u", "v", "w"])
    assert bricks.count() == 4
    start = seeds.box(spark, ((1, 2), (1, 2), (1, 2)), grid)
    r = T.trace(start, bricks, T.Plan(grid, "rk1_3d", 1.0, 4, round_steps=3))
    got = {(p.x, p.y, p.z) for p in r.particles.collect()}
    assert got == {(x + 2.0, y + 1.0, z + 0.5) for x in (1, 2) for y in (1, 2) for z in (1, 2)}


def test_known_seed_counts():
    assert [len(seeds.axis(n, s)) for n, s in ((16, 512), (250, 500), (50, 100), (128, 500), (32, 100), (512, 512), (40, 64))] == [15, 249, 49, 127, 31, 512, 40]


def test_setups(spark):
    grid = Grid.of((288, 181, 72, 24), 2, 1)
    assert seeds.of_setup(spark, "atmosphere_4d", grid).count() == 38 * 24 * 72 * 24
    assert seeds.of_setup(spark, "synthetic_2d", Grid.of((64, 64), 1, 0)).count() == 39 * 39


def test_join_and_gather_interpolate_alike(spark):
    size = (8, 6)
    f = fields.analytic(spark, "rotation", size, 0.5, dtype="double")
    p = spark.range(50).select("id", (F.rand(3) * 6.9).alias("x"), (F.rand(4) * 4.9).alias("y")).cache()
    got = {r["id"]: (r["u"], r["v"]) for r in lerp_join(p, f, ["x", "y"], ["u", "v"], "id").collect()}
    for r in p.collect():
        assert np.allclose(got[r["id"]], (-0.5 * (r["y"] - 2.5), 0.5 * (r["x"] - 3.5)))
