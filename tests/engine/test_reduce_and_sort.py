import pytest
from pyspark.sql import functions as F

from gridtrace.operators import kdtree, metrics, pick, reduce, sorting
from gridtrace.plans.grid import Grid


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (9.99,)], "v double")
    assert dict(reduce.histogram(df, F.col("v"), 0, 10, 4).collect()) == {0: 2, 3: 2}
    with pytest.raises(Exception, match="under the histogram"):
        reduce.histogram(spark.createDataFrame([(-1.0,)], "v double"), F.col("v"), 0, 10, 4).collect()


def test_vector_sum_over_blocks(spark):
    df = spark.range(16).select(F.col("id").alias("gid"), F.sequence(F.lit(0), F.lit(4)).alias("values"))
    assert dict(reduce.vector_sum(df, "values").collect()) == {p: 16 * p for p in range(5)}


def test_chain_of_blocks(spark):
    df = spark.range(128).select(F.col("id").alias("gid"), (F.col("id") * 9 + 3).alias("sum"))
    got = {r.gid: r.average for r in reduce.chain_average(df).collect()}
    assert got[0] == 12 and got[127] == 1137 and all(got[g] == 9 * g + 3 for g in range(1, 127))


def test_all_done_counts(spark):
    n = 9
    for rule, total in (("1", n), ("id % 2", n // 2), ("0", 0)):
        df = spark.range(n).selectExpr("id AS gid", f"CAST({rule} AS BIGINT) AS work")
        assert reduce.reduce_ops(df, "work", ["plus"]).first()[0] == total


def test_scan_over_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: (r.scan, r.ex) for r in reduce.scan(reduce.scan(df, "v", ["id"]), "v", ["id"], exclusive=True, name="ex").collect()}
    s = 0
    for i in range(1000):
        assert got[i] == (s + i % 7, s)
        s += i % 7


def test_partners():
    assert reduce.partners(8, 2) == [(2, 1), (2, 2), (2, 4)] and reduce.partners(12, 4) == [(4, 1), (3, 4)]
    assert reduce.group_members(5, 2, 4) == [1, 5] and reduce.log_rounds(64, 4) == 3


def test_iterate_and_limits(spark):
    df = spark.createDataFrame([(0, 3), (1, 1)], "gid int, left int")
    out, rounds = reduce.iterate_until_done(df, lambda d: d.withColumn("left", F.greatest(F.lit(0), F.col("left") - 1)), F.col("left") == 0)
    assert rounds == 3 and out.count() == 2
    with pytest.raises(RuntimeError):
        reduce.iterate_until_done(df, lambda d: d, F.lit(False), most=2)
    with pytest.raises(ValueError):
        reduce.broadcast_value(df, spark.range(10), most=5)


def test_summary_of_deviations(spark):
    r = reduce.summary(spark.createDataFrame([(1,), (2,), (6,)], "v int"), "v").first()
    assert (r["max"], r["min"], r["avg"], r["sum"]) == (6, 1, 3.0, 9) and abs(r["l2_deviation"] - 14**0.5) < 1e-9


@pytest.mark.parametrize("n", [2, 4, 7])
def test_sorts_keep_all_and_order(spark, n):
    df = spark.range(2000).select((F.col("id") % 8).alias("gid"), F.floor(F.rand(5) * 1024).alias("value"))
    df = df.cache()
    for got in (sorting.sample_sort(df, "gid", "value", n), sorting.histogram_sort(df, "value", 0, 1024, n)):
        spans = sorted((r["bucket"], r["lo"], r["hi"], r["c"]) for r in got.groupBy("bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("c")).collect())
        assert sum(s[3] for s in spans) == 2000 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert len(sorting.sample_sort(df, "gid", "value", n, samples_only=True)) == n - 1
    assert sorting.dividers_of([], 4) == []
    rows = [r["value"] for r in sorting.global_sort(df, "value", n=3).collect()]
    assert rows == sorted(rows)


def kd_check(spark, pts, nodes, lo, hi):
    boxes = {n.path: n for n in nodes}
    for r in pts.collect():
        b = boxes[r["node"]]
        assert all(a <= x <= c for x, a, c in zip(r["p"], b.lo, b.hi))
    area = sum((n.hi[0] - n.lo[0]) * (n.hi[1] - n.lo[1]) for n in nodes)
    assert abs(area - (hi[0] - lo[0]) * (hi[1] - lo[1])) < 1
    got = {(r["gid"], r["nbr"]) for r in kdtree.leaf_links(kdtree.leaves_df(spark, nodes)).collect()}
    meet = lambda a, b: all(a.lo[d] <= b.hi[d] and b.lo[d] <= a.hi[d] for d in range(2))
    assert got == {(a.path, b.path) for a in nodes for b in nodes if a.path != b.path and meet(a, b)}


@pytest.mark.parametrize("blocks", [2, 8])
@pytest.mark.parametrize("skewed", [False, True])
def test_kd_trees(spark, blocks, skewed):
    x = "least(1000, -ln(1 - u) * 60)" if skewed else "u * 1000"
    pts = spark.range(100 * blocks).select("id", F.rand(1).alias("u"), F.rand(2).alias("v")).selectExpr("id", f"array({x}, v * 1000) AS p").cache()
    lo, hi = (0.0, 0.0), (1000.0, 1000.0)
    at, nodes = kdtree.histogram_tree(pts, lo, hi, blocks, 64)
    kd_check(spark, at, nodes, lo, hi)
    at, nodes = kdtree.sampling_tree(pts, lo, hi, blocks, 64)
    kd_check(spark, at, nodes, lo, hi)
    counts = [r["count"] for r in at.groupBy("node").count().collect()]
    assert max(counts) < 2.5 * 100


def test_empty_nodes_and_periodic_links(spark):
    pts = spark.createDataFrame([([1.0, 1.0],)], "p array<double>")
    _, nodes = kdtree.histogram_tree(pts, (0.0, 0.0), (8.0, 8.0), 4, 8)
    assert all(n.lo < n.hi for n in nodes)
    grid = Grid.of((8, 8), 4, 1)
    leaves = kdtree.leaves_df(spark, kdtree.constrained(None, grid, first=True)[1])
    wraps = kdtree.leaf_links(leaves, [7.0, 7.0])
    assert wraps.where("exists(wrap, s -> s <> 0)").count() > 0 and wraps.where("gid = nbr").count() == 0
    two = kdtree.leaves_df(spark, kdtree.constrained(None, Grid.of((8, 8), 2, 1), first=True)[1])
    assert kdtree.leaf_links(two, [7.0, 7.0]).where("gid = nbr").count() > 0  # a leaf as wide as the domain meets itself


def test_pick_limits(spark):
    boxes = spark.createDataFrame([(0, 0.0, 1.0), (1, 2.0, 3.0)], "gid int, lo_x double, hi_x double")
    pts = spark.createDataFrame([(0, 0.5), (0, 1.9)], "gid int, x double")
    assert [(r["x"], r["nbr"]) for r in pick.near(pts, boxes, ["x"], 0.2).collect()] == [(1.9, 1)]
    assert pick.in_(pts, boxes, ["x"]).count() == 0
    with pytest.raises(ValueError):
        pick.near(pts, boxes, ["x"], 1.0, most_boxes=1)


def test_metrics_and_sinks(spark, tmp_path):
    work = spark.createDataFrame([(0, 0, 10, 0), (0, 1, 30, 0), (1, 0, 0, 1), (1, 1, 0, 1)], "round int, gid int, steps long, finished long")
    b = {r["round"]: r for r in metrics.round_balance(work).collect()}
    assert b[0]["balance"] == 1.5 and b[0]["imbalance"] == 1 / 3 and b[1]["balance"] is None and b[1]["cum_max"] == 30
    assert metrics.load_balance(work).first()["load_balance"] == 1.5
    t = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 1, 3.0), (0, 2, 3, 3.5)], "worker int, seq int, category int, at double")
    d = metrics.timeline_deltas(t)
    assert [r["dt"] for r in d.orderBy("seq").collect()] == [2.0, 0.5]
    s = metrics.time_summary(d, 10.0, 1)
    assert s["time_pure_run"] == 9.5 and s["time_idle"] == 7.5 and "time_run" in metrics.report(s)
    metrics.write_timeline(d, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "0\t1:2.0,3:0.5"
    metrics.write_balance(metrics.round_balance(work).where("round = 0").withColumn("sec", F.lit(2.5)), "sec", str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b")).first()[0] == "2.5:1.5"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run_04").write_text("x\ntime_run= 12.5\n")
    r = metrics.parse_logs(spark, str(tmp_path / "logs")).first()
    assert (r["processes"], r["time_run"]) == (4, 12.5)
    assert metrics.termination(spark.createDataFrame([], "finished boolean")).first()["stop"]


def test_sorts_are_in_order_over_partitions(spark):
    from pyspark.sql import functions as F

    from gridtrace.operators import sorting

    df = spark.range(3000).select((F.col("id") % 5).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1000))).cast("double").alias("v"))
    for got in (sorting.sample_sort(df, "g", "v", 6), sorting.histogram_sort(df, "v", 0, 1000, 6)):
        rows = [(r.p, r.v) for r in got.select(F.spark_partition_id().alias("p"), "v").collect()]
        values = [v for _, v in sorted(rows, key=lambda r: r[0])]  # stable: rows of a partition stay as they lie
        assert len(values) == 3000 and values == sorted(values) and len({p for p, _ in rows}) > 1


def test_scan_of_groups_over_several_partitions(spark):
    from gridtrace.operators import reduce

    rows = [("hot", i, i % 7) for i in range(2000)] + [(None, i, 1) for i in range(30)] + [("a", 1, 5), ("z", 2, 6), ("z", 3, None)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    for exclusive in (False, True):
        got = {(r.g, r.i): r.scan for r in reduce.scan(df, "v", ["i"], ["g"], exclusive=exclusive).collect()}
        sums = {}
        for g, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            sums[g] = sums.get(g, 0) + (v or 0)
            if v is not None:
                assert got[g, i] == sums[g] - (v if exclusive else 0)
        assert len(got) == len(rows)


def test_bricks_of_a_wrapped_grid_are_whole(spark):
    import numpy as np

    from gridtrace.plans.grid import Grid
    from gridtrace.sources import fields

    grid = Grid.of((8, 8), 4, 2, wrap=(True, True))
    bricks = fields.to_bricks(fields.vertices(spark, (8, 8)).selectExpr("x", "y", "CAST(x + 10 * y AS DOUBLE) AS u"), grid, ["u"], "float64").collect()
    assert len(bricks) == 4
    for b in bricks:
        data = np.frombuffer(b.data).reshape(b.shape)[0]
        lo = b.start
        for j in range(data.shape[0]):
            for i in range(data.shape[1]):
                assert data[j, i] == (lo[0] + i) % 8 + 10 * ((lo[1] + j) % 8)
