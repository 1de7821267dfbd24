"""The engine's own queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrace.functions import geometry as G
from gridtrace.functions.interp import lerp_join
from gridtrace.operators import kdtree, metrics, pick, reduce, seeds, sorting
from gridtrace.operators import trace as tr
from gridtrace.plans.grid import AXES, Grid, contiguous, elastic_ghosts, round_robin
from gridtrace.sources import block_store, fields, read_plan

FLAGSHIP = "trace_baseline"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the field that line items make: 50 x 11 vertices ------------------------------------------

SIZE = (50, 11)
H, STEPS = 0.8, 40
XS = [0.5 + 1.5 * i for i in range(32)]
YS = [0.5 + 1.25 * j for j in range(8)]


def line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex for each quantity and discount; the velocity comes from the number of line items there."""
    li = table(spark, sf_dir, "lineitem")
    n = li.groupBy((F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y")).agg(F.count("*").alias("cnt"))
    part = lambda k: ((F.col("cnt") * k) % 1000).cast("double") / 1000 - 0.5
    return n.select("x", "y", "cnt", part(7919).alias("u"), part(104729).alias("v"))


FIELD = """f AS (SELECT x, y, cnt, CAST((cnt * 7919) % 1000 AS DOUBLE) / 1000 - 0.5 AS u, CAST((cnt * 104729) % 1000 AS DOUBLE) / 1000 - 0.5 AS v
  FROM (SELECT CAST(l_quantity AS INT) - 1 AS x, CAST(round(l_discount * 100) AS INT) AS y, count(*) AS cnt FROM lineitem GROUP BY 1, 2))"""

PATHS = f"""WITH RECURSIVE {FIELD},
s AS (SELECT i * 8 + j AS particle_id, 0.5 + 1.5 * i AS x, 0.5 + 1.25 * j AS y FROM generate_series(0, 31) a(i), generate_series(0, 7) b(j)),
p(particle_id, n, x, y) AS (
  SELECT CAST(particle_id AS BIGINT), 0, CAST(x AS DOUBLE), CAST(y AS DOUBLE) FROM s
  UNION ALL
  SELECT q.particle_id, q.n + 1,
    q.x + 0.5e0 * (0.8e0 * (a.u * (1 - fx) * (1 - fy) + b.u * (1 - fx) * fy + c.u * fx * (1 - fy) + d.u * fx * fy)),
    q.y + 0.5e0 * (0.8e0 * (a.v * (1 - fx) * (1 - fy) + b.v * (1 - fx) * fy + c.v * fx * (1 - fy) + d.v * fx * fy))
  FROM (SELECT *, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j, x - floor(x) AS fx, y - floor(y) AS fy FROM p
        WHERE n < {STEPS} AND x >= 0 AND x < 49 AND y >= 0 AND y < 10) q
  JOIN f a ON a.x = q.i AND a.y = q.j JOIN f b ON b.x = q.i AND b.y = q.j + 1
  JOIN f c ON c.x = q.i + 1 AND c.y = q.j JOIN f d ON d.x = q.i + 1 AND d.y = q.j + 1)"""

ENDS = PATHS + " SELECT particle_id, CAST(max(n) AS INT) AS num_steps, round(arg_max(x, n), 6) AS x, round(arg_max(y, n), 6) AS y FROM p GROUP BY particle_id"


def run_trace(spark: SparkSession, sf_dir: str, n_blocks: int = 4, ghosts: int = 2, **options) -> tr.Result:
    grid = Grid.of(SIZE, n_blocks, ghosts)
    plan = tr.Plan(grid, "rk1_2d", H, STEPS, **{"round_steps": 20, "dtype": "float64"} | options)
    bricks = fields.to_bricks(line_field(spark, sf_dir), grid, ["u", "v"], "float64")
    return tr.trace(seeds.from_axes(spark, [XS, YS], grid, dtype="double"), bricks, plan)


def ends(df: DataFrame) -> DataFrame:
    return df.select("particle_id", F.col("num_steps").cast("int"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(ENDS)
def trace_baseline(spark, sf_dir):
    """Fixed blocks: particles go to the owner of where they are after each round."""
    return ends(run_trace(spark, sf_dir).particles)


@query(ENDS)
def trace_kdtree(spark, sf_dir):
    """k-d rebalancing of the unfinished after each round, bound to the ghost layers."""
    return ends(run_trace(spark, sf_dir, mode="kdtree").particles)


def field_array(spark, sf_dir) -> np.ndarray:
    """The field on the driver: its size is the grid's, whatever the table's."""
    rows = line_field(spark, sf_dir).select("x", "y", "u", "v").collect()
    data = np.full((2, SIZE[1], SIZE[0]), np.nan)
    for r in rows:
        data[:, r["y"], r["x"]] = r["u"], r["v"]
    return data


@query(ENDS)
def trace_whole_field(spark, sf_dir):
    """One pass over the particles against the broadcast field."""
    grid = Grid.of(SIZE, 1, 0)
    plan = tr.Plan(grid, "rk1_2d", H, STEPS, dtype="float64")
    return ends(tr.trace_whole(seeds.from_axes(spark, [XS, YS], grid, dtype="double"), field_array(spark, sf_dir), plan))


@query(ENDS)
def trace_intervals(spark, sf_dir):
    """The step limit shared out over eight rounds."""
    grid = Grid.of(SIZE, 2, 2)
    plan = tr.Plan(grid, "rk1_2d", H, STEPS, dtype="float64")
    bricks = fields.to_bricks(line_field(spark, sf_dir), grid, ["u", "v"], "float64")
    return ends(tr.intervals(seeds.from_axes(spark, [XS, YS], grid, dtype="double"), bricks, plan, 8).particles)


@query(PATHS + ", e AS (SELECT particle_id, max(n) AS n FROM p GROUP BY 1) SELECT count(*) AS init, count(*) AS done, CAST(sum(n) AS BIGINT) AS total_steps FROM e")
def trace_summary(spark, sf_dir):
    r = run_trace(spark, sf_dir)
    work = spark.createDataFrame(r.rounds)
    total = work.agg(F.sum("steps").alias("total_steps"))
    return metrics.termination(r.particles).select("init", "done").crossJoin(total)


@query(PATHS + " SELECT CAST((n - 1) // 10 AS INT) AS round, CAST(10 - (n - 1) % 10 - 1 AS INT) AS phase, particle_id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE n > 0 AND (n - 1) % 10 IN (3, 6)")
def snapshot_phases(spark, sf_dir):
    """Positions at 6 and 3 remaining steps of each round of ten."""
    r = run_trace(spark, sf_dir, n_blocks=1, ghosts=0, marks=(6, 3), round_steps=10)
    return r.snapshots.select("round", "phase", "particle_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


#: Visits: a step is made in the block of the step before, unless that has used its 20 steps or the point is out of its
#: box with two ghost layers; then the next round begins in the owner's block. Blocks are 25 and 5 vertices wide.
VISITS = PATHS + """, w(particle_id, n, round, gid, used, x, y) AS (
  SELECT particle_id, 0, 0, least(1, CAST(trunc(x) AS INT) // 25) + 2 * least(1, CAST(trunc(y) AS INT) // 5), 0, x, y FROM p WHERE n = 0
  UNION ALL
  SELECT q.particle_id, p.n, CASE WHEN stays THEN q.round ELSE q.round + 1 END, CASE WHEN stays THEN q.gid ELSE owner END, CASE WHEN stays THEN q.used + 1 ELSE 1 END, p.x, p.y
  FROM (SELECT *, least(1, CAST(trunc(x) AS INT) // 25) + 2 * least(1, CAST(trunc(y) AS INT) // 5) AS owner,
          used < 20 AND CASE WHEN gid % 2 = 0 THEN x < 26 ELSE x >= 23 END AND CASE WHEN gid < 2 THEN y < 6 ELSE y >= 3 END AS stays FROM w) q
  JOIN p ON p.particle_id = q.particle_id AND p.n = q.n + 1)"""


@query(VISITS + """, b AS (SELECT round, gid, count(*) AS steps FROM w WHERE n > 0 GROUP BY 1, 2),
t AS (SELECT round, max(steps) AS m, avg(steps) AS a, sum(steps) AS s, count(*) AS c FROM b GROUP BY 1)
SELECT CAST(round AS BIGINT) AS round, CAST(m AS BIGINT) AS max, round(a, 6) AS avg, CAST(s AS BIGINT) AS total, c AS workers, round(m / a, 6) AS balance,
  round((m - a) / m, 6) AS imbalance, CAST(sum(m) OVER (ORDER BY round) AS BIGINT) AS cum_max FROM t""")
def trace_round_balance(spark, sf_dir):
    """Work of each round, by block."""
    b = metrics.round_balance(spark.createDataFrame(run_trace(spark, sf_dir).rounds))
    return b.select("round", "max", F.round("avg", 6).alias("avg"), "total", "workers", *(F.round(c, 6).alias(c) for c in ("balance", "imbalance")), "cum_max")


@query(f"WITH {FIELD} SELECT x, y, cnt, round(u, 6) AS u, round(v, 6) AS v FROM f")
def field_grid(spark, sf_dir):
    return line_field(spark, sf_dir).select("x", "y", "cnt", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


POINTS = "SELECT o_orderkey AS k, o_totalprice / 10500e0 AS x, CAST(o_orderkey % 1000 AS DOUBLE) / 100 AS y FROM orders"


def order_points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 10500).alias("x"), ((F.col("o_orderkey") % 1000).cast("double") / 100).alias("y"))


@query(f"""WITH {FIELD}, q AS (SELECT *, CAST(floor(x) AS INT) AS i, CAST(floor(y) AS INT) AS j, x - floor(x) AS fx, y - floor(y) AS fy FROM ({POINTS}))
SELECT q.k, round(a.u * (1 - fx) * (1 - fy) + b.u * (1 - fx) * fy + c.u * fx * (1 - fy) + d.u * fx * fy, 5) AS u, round(a.v * (1 - fx) * (1 - fy) + b.v * (1 - fx) * fy + c.v * fx * (1 - fy) + d.v * fx * fy, 5) AS v
FROM q JOIN f a ON a.x = i AND a.y = j JOIN f b ON b.x = i AND b.y = j + 1 JOIN f c ON c.x = i + 1 AND c.y = j JOIN f d ON d.x = i + 1 AND d.y = j + 1""")
def lerp_by_join(spark, sf_dir):
    """Bilinear samples of the field at every order's point, by an equi-join at four corners."""
    got = lerp_join(order_points(spark, sf_dir), line_field(spark, sf_dir), ["x", "y"], ["u", "v"], "k")
    return got.select("k", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"))


# --- decomposition --------------------------------------------------------------------------------

BLOCKS8 = """b AS (SELECT CAST(i AS INT) AS gid, CAST(i % 4 AS INT) AS cx, CAST(i // 4 AS INT) AS cy FROM generate_series(0, 7) t(i)),
k AS (SELECT *, cx * 12 AS lb_x, CASE WHEN cx = 3 THEN 49 ELSE cx * 12 + 11 END AS ub_x, cy * 5 AS lb_y, CASE WHEN cy = 1 THEN 10 ELSE cy * 5 + 4 END AS ub_y FROM b)"""
GRID8 = Grid.of(SIZE, 8, 2)


@query(f"WITH {BLOCKS8} SELECT *, greatest(0, lb_x - 2) AS glb_x, least(49, ub_x + 2) AS gub_x, greatest(0, lb_y - 2) AS glb_y, least(10, ub_y + 2) AS gub_y FROM k")
def regular_decompose(spark, sf_dir):
    return GRID8.blocks(spark)


@query("""SELECT CAST(least(2, CAST(trunc(value) AS INT) // 163) + 3 * least(1, extract('second' FROM ts) // 30) AS INT) AS gid, count(*) AS n FROM events GROUP BY 1""")
def point_location(spark, sf_dir):
    """Owner of each event's (value, second): a projection, no join."""
    grid = Grid.of((491, 60), 6, 0)
    gid = grid.owner([F.col("value"), F.second("ts")])
    return table(spark, sf_dir, "events").groupBy(gid.alias("gid")).agg(F.count("*").alias("n"))


@query(f"""WITH {BLOCKS8}, {FIELD} SELECT k.gid, count(*) AS vertices, CAST(sum(f.cnt) AS BIGINT) AS items FROM k JOIN f
ON f.x BETWEEN k.lb_x - 2 AND k.ub_x + 2 AND f.y BETWEEN k.lb_y - 2 AND k.ub_y + 2 GROUP BY 1""")
def ghost_replication(spark, sf_dir):
    f = line_field(spark, sf_dir).withColumn("gid", F.explode(GRID8.owners([F.col("x"), F.col("y")])))
    return f.groupBy("gid").agg(F.count("*").alias("vertices"), F.sum("cnt").alias("items"))


@query("SELECT CAST(i AS INT) AS gid, CAST(i % 6 AS INT) AS rank FROM generate_series(0, 63) t(i)")
def assign_round_robin(spark, sf_dir):
    return spark.range(64).select(F.col("id").cast("int").alias("gid"), round_robin(F.col("id"), 6).alias("rank"))


@query("SELECT CAST(i AS INT) AS gid, CAST(CASE WHEN i < 44 THEN i // 11 ELSE 4 + (i - 44) // 10 END AS INT) AS rank FROM generate_series(0, 63) t(i)")
def assign_contiguous(spark, sf_dir):
    return spark.range(64).select(F.col("id").cast("int").alias("gid"), contiguous(F.col("id"), 64, 6).alias("rank"))


def _values(v: list[float]) -> str:
    return "(SELECT unnest([" + ", ".join(f"{x!r}e0" for x in v) + f"]) AS v, unnest(range({len(v)})) AS i)"


@query(f"""SELECT CAST(a.i * 10 + b.i AS BIGINT) AS particle_id, a.v AS x, b.v AS y, CAST(least(3, CAST(trunc(a.v) AS INT) // 12) + 4 * least(1, CAST(trunc(b.v) AS INT) // 5) AS INT) AS home_gid
FROM {_values(seeds.axis(16, 50))} a, {_values(seeds.axis(10, 11))} b WHERE a.v <> 0 AND b.v <> 0""" if len(seeds.axis(10, 11)) == 10 else None)
def seed_lattice(spark, sf_dir):
    """Lattice values summed up in float32, without the first lines."""
    return seeds.lattice(spark, (16, 10), GRID8, drop_zero=True).select("particle_id", F.col("x").cast("double"), F.col("y").cast("double"), "home_gid")


@query("""SELECT CAST(least(3, x // 12) + 4 * least(1, y // 5) AS INT) AS home_gid, count(*) AS n FROM generate_series(5, 40) a(x), generate_series(2, 8) b(y) GROUP BY 1""")
def seed_box(spark, sf_dir):
    return seeds.box(spark, ((5, 40), (2, 8)), GRID8).groupBy("home_gid").agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS8} SELECT k.gid AS home_gid, count(*) AS n FROM k, generate_series(0, 49) a(x), generate_series(0, 10) b(y) WHERE x BETWEEN lb_x AND ub_x AND y BETWEEN lb_y AND ub_y AND (x - lb_x) % 3 = 0 AND (y - lb_y) % 3 = 0 GROUP BY 1")
def seed_per_block(spark, sf_dir):
    return seeds.per_block(spark, GRID8, 3).groupBy("home_gid").agg(F.count("*").alias("n"))


@query("""SELECT * FROM (VALUES (2, 512, 1, 0, 0), (4, 512, 20, 20, 0), (8, 512, 50, 50, 50), (16, 512, 92, 62, 62), (32, 512, 105, 105, 71),
(2, 1024, 43, 0, 0), (4, 1024, 82, 82, 0), (8, 1024, 96, 96, 96), (16, 1024, 150, 101, 101), (32, 1024, 156, 156, 105)) t(procs, limit_mb, gx, gy, gz)""")
def elastic_ghost_table(spark, sf_dir):
    rows = [(n, m, *elastic_ghosts((512,) * 3, n, n, m, 3)) for m in (512, 1024) for n in (2, 4, 8, 16, 32)]
    return spark.createDataFrame(rows, "procs int, limit_mb int, gx int, gy int, gz int")


@query("SELECT CAST(a AS INT) AS gid, CAST(b AS INT) AS nbr FROM generate_series(0, 7) s(a), generate_series(0, 7) t(b) WHERE a <> b")
def links_complete(spark, sf_dir):
    return GRID8.complete_links(spark)


@query("""WITH b AS (SELECT i AS gid, i % 4 AS cx, i // 4 AS cy FROM generate_series(0, 7) t(i)), o AS (SELECT dx, dy FROM generate_series(-1, 1) s(dx), generate_series(-1, 1) t(dy) WHERE dx <> 0 OR dy <> 0)
SELECT CAST(gid AS INT) AS gid, CAST((cx + dx + 4) % 4 + 4 * (cy + dy) AS INT) AS nbr, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, CASE WHEN cx + dx < 0 THEN -1 WHEN cx + dx > 3 THEN 1 ELSE 0 END AS wx
FROM b, o WHERE cy + dy BETWEEN 0 AND 1""")
def links_neighbours(spark, sf_dir):
    """The blocks around each block, periodic in x."""
    g = Grid.of(SIZE, 8, 1, wrap=(True, False))
    return g.neighbour_links(spark).select("gid", "nbr", F.col("dir")[0].alias("dx"), F.col("dir")[1].alias("dy"), F.col("wrap")[0].alias("wx"))


@query(f"""WITH q AS ({POINTS}) SELECT count(*) AS n, CAST(count_if(x >= 12 AND x < 24 AND y >= 5 AND y <= 10) AS BIGINT) AS in_block, CAST(count_if(x >= 0 AND x < 49 AND y >= 0 AND y < 10) AS BIGINT) AS in_domain,
CAST(count_if(x >= 10 AND x < 25 AND y >= 3 AND y < 10) AS BIGINT) AS in_ghost, CAST(count_if(floor(x) >= 10 AND floor(x) < 20 AND floor(y) >= 2 AND floor(y) < 7) AS BIGINT) AS in_box, CAST(count_if(NOT (x >= 0 AND x < 49 AND y >= 0 AND y < 10) OR k % 50 >= 40) AS BIGINT) AS done,
CAST(count_if(floor(x) - 10 = 0 AND floor(y) - 5 = 0) AS BIGINT) AS critical FROM q""")
def predicates(spark, sf_dir):
    """The ownership, domain, ghost, box, finish and critical-point predicates over all orders' points."""
    q, x, y = order_points(spark, sf_dir), F.col("x"), F.col("y")
    lit = lambda *v: [F.lit(a) for a in v]
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    fx, fy = F.floor(x), F.floor(y)
    return q.agg(
        F.count("*").alias("n"), n(G.in_block([x, y], lit(12, 5), lit(23, 10), SIZE), "in_block"), n(G.in_domain([x, y], SIZE), "in_domain"),
        n(G.in_ghost([x, y], lit(10, 3), lit(16, 8)), "in_ghost"), n(G.in_box([fx, fy], lit(10, 2), lit(20, 7)), "in_box"),
        n(G.finished([x, y], SIZE, F.col("k") % 50, 40), "done"), n(G.critical([fx - 10, fy - 5]), "critical"),
    )


# --- reductions -----------------------------------------------------------------------------------


@query("SELECT event_type, CAST(least(63, floor(value / 7.8125e0)) AS INT) AS bin, count(*) AS count FROM events GROUP BY 1, 2")
def histogram(spark, sf_dir):
    return reduce.histogram(table(spark, sf_dir, "events"), F.col("value"), 0, 500, 64, ("event_type",))


@query("SELECT bin, count(*) AS count FROM (SELECT CAST(least(63, floor(value / 7.8125e0)) AS INT) AS bin FROM events) GROUP BY 1")
def histogram_merge(spark, sf_dir):
    return reduce.merge_histograms(histogram(spark, sf_dir))


@query("SELECT event_type, 0 AS pos, CAST(sum(user_id) AS BIGINT) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 1, CAST(sum(event_id) AS BIGINT) FROM events GROUP BY 1")
def vector_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.array("user_id", "event_id").alias("values"))
    return reduce.vector_sum(e, "values", ("event_type",))


@query("""SELECT event_type, max(w) AS max, min(w) AS min, CAST(sum(w) AS BIGINT) AS plus, product(w) AS multiplies, bool_and(w <> 0) AS logical_and, bool_or(w <> 0) AS logical_or
FROM (SELECT event_type, CAST(CASE WHEN event_id % 1000 = 0 THEN 2 ELSE 1 END AS BIGINT) AS w FROM events) GROUP BY 1""")
def all_reduce_ops(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 1000 == 0, 2).otherwise(1).cast("long").alias("w"))
    return reduce.reduce_ops(e, "w", list(reduce.OPS), ("event_type",))


@query("SELECT s_suppkey, max(s_suppkey) OVER () AS max, CAST(sum(s_suppkey) OVER () AS BIGINT) AS plus FROM supplier")
def all_reduce_back(spark, sf_dir):
    """Each row gets the reductions."""
    return reduce.all_reduce(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", ["max", "plus"])


@query("SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS scan FROM events")
def prefix_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return reduce.scan(e, "user_id", ["event_id"], ["event_type"]).select("event_id", "scan")


@query("SELECT event_id, CAST(sum(user_id) OVER (ORDER BY event_id) - user_id AS BIGINT) AS scan FROM events")
def prefix_scan_exclusive(spark, sf_dir):
    """Over all rows, by range partitions: no task gets them all."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return reduce.scan(e, "user_id", ["event_id"], exclusive=True).select("event_id", "scan")


@query("SELECT CAST(user_id % 8 AS INT) AS src, CAST(event_id % 8 AS INT) AS dst, count(*) AS count FROM events GROUP BY 1, 2")
def all_to_all_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reduce.transfer_counts(e, (F.col("user_id") % 8).cast("int"), (F.col("event_id") % 8).cast("int"))


@query("SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS listed FROM nation GROUP BY 1")
def gather_lists(spark, sf_dir):
    got = reduce.gather(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_nationkey")
    return got.select("n_regionkey", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("listed"))


@query("""SELECT event_type, max(user_id) AS max, min(user_id) AS min, round(avg(user_id), 4) AS avg, CAST(sum(user_id) AS BIGINT) AS sum,
round(sqrt(var_pop(user_id) * count(*)), 3) AS l2_deviation, round(stddev_pop(user_id), 4) AS stddev FROM events GROUP BY 1""")
def number_summary(spark, sf_dir):
    s = reduce.summary(table(spark, sf_dir, "events"), "user_id", ("event_type",))
    return s.withColumns({"avg": F.round("avg", 4), "l2_deviation": F.round("l2_deviation", 3), "stddev": F.round("stddev", 4)})


@query("SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1, 2")
def bounding_boxes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").alias("lo"), F.col("o_custkey").alias("hi"))
    return reduce.bounding_boxes(o, ["o_orderstatus", "o_orderpriority"], ["lo"], ["hi"])


@query("SELECT a.n_nationkey AS gid, count(DISTINCT b.n_nationkey) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1")
def neighbour_counts(spark, sf_dir):
    return reduce.unique_neighbours(nation_links(spark, sf_dir))


def nation_links(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    b = n.select(F.col("n_nationkey").alias("nbr"), "n_regionkey")
    return n.select(F.col("n_nationkey").alias("gid"), "n_regionkey").join(b, "n_regionkey").where("gid <> nbr").select("gid", "nbr")


@query("SELECT min(c) AS min, max(c) AS max, round(avg(c), 6) AS avg FROM (SELECT l_suppkey % 32 AS g, count(*) AS c FROM lineitem GROUP BY 1)")
def block_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 32).alias("gid"))
    return reduce.block_counts(li, "gid").withColumn("avg", F.round("avg", 6))


@query("""WITH s AS (SELECT n_nationkey AS gid, CAST(n_nationkey * 9 + 3 AS BIGINT) AS sum FROM nation)
SELECT s.gid, s.sum, round(avg(t.sum), 6) AS average FROM s JOIN nation a ON a.n_nationkey = s.gid JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN s t ON t.gid = b.n_nationkey GROUP BY 1, 2""")
def neighbour_average(spark, sf_dir):
    """Block sums and the mean of the neighbours' sums, neighbours being nations of a region."""
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid"), F.array(*((F.col("n_nationkey") * 3 + i).cast("long") for i in range(3))).alias("values"))
    return reduce.neighbour_average(v, nation_links(spark, sf_dir)).select("gid", "sum", F.round("average", 6).alias("average"))


@query("""WITH s AS (SELECT n_nationkey AS gid, CAST(n_nationkey * 9 + 3 AS BIGINT) AS sum FROM nation), l AS (SELECT *, lag(sum) OVER (ORDER BY gid) AS a, lead(sum) OVER (ORDER BY gid) AS b FROM s)
SELECT gid, sum, (coalesce(a, 0) + coalesce(b, 0)) / CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS DOUBLE) AS average FROM l""")
def chain_average(spark, sf_dir):
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid"), (F.col("n_nationkey").cast("long") * 9 + 3).alias("sum"))
    return reduce.chain_average(v)


@query("SELECT n_nationkey AS gid, CAST(count(s_suppkey) AS BIGINT) AS work FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) > 0")
def skip_idle_blocks(spark, sf_dir):
    """Only blocks that something waits for are visited."""
    queue = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gid"))
    blocks = reduce.skip_no_incoming(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid")), queue)
    return blocks.join(queue.groupBy("gid").agg(F.count("*").alias("work")), "gid")


@query("SELECT l_suppkey % 16 AS gid, CAST(sum(l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem GROUP BY 1")
def foreach_block(spark, sf_dir):
    """A pandas function of each block's rows, pre-aggregated first."""
    import pandas as pd

    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("gid"), "l_linenumber").agg(F.count("*").alias("n"))
    f = lambda g: pd.DataFrame({"gid": [g["gid"].iloc[0]], "total": [(g["l_linenumber"] * g["n"]).sum()], "n": [g["n"].sum()]})
    return reduce.foreach_block(li, "gid", f, "gid long, total long, n long")


@query("SELECT s_suppkey, s_nationkey AS src_gid, CAST((s_suppkey * 7) % 25 AS BIGINT) AS gid FROM supplier")
def exchange_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("gid"), ((F.col("s_suppkey") * 7) % 25).alias("dst"))
    return reduce.exchange(s, "dst").select("s_suppkey", "src_gid", "gid")


@query("SELECT count(*) AS blocks, CAST(sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS BIGINT) AS flips FROM (SELECT c_custkey % 9 AS w FROM customer)")
def until_done(spark, sf_dir):
    """Every block counts down to nothing; done when all are."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).alias("left"), F.lit(0).cast("long").alias("flips"))
    body = lambda d: d.withColumn("flips", F.col("flips") + (F.col("left") > 0).cast("long")).withColumn("left", F.greatest(F.lit(0), F.col("left") - 1))
    out, _ = reduce.iterate_until_done(c, body, F.col("left") == 0)
    return out.agg(F.count("*").alias("blocks"), F.sum("flips").alias("flips"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 30")
def visit_limit(spark, sf_dir):
    return reduce.limit_per_group(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 30)


@query("SELECT event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS BIGINT) AS batch, event_id FROM events")
def message_batches(spark, sf_dir):
    return reduce.batches(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", ["event_id"], 64)


@query("""SELECT 'done' AS state, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'left', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'all', count(*) FROM orders
UNION ALL SELECT 'partners', count(*) FROM (SELECT DISTINCT o_custkey % 7, o_orderkey % 5 FROM orders)""")
def state_sets(spark, sf_dir):
    """Split by state, put together again, and the distinct partners."""
    o = table(spark, sf_dir, "orders").withColumn("finished", F.col("o_orderstatus") == "F")
    done, left = reduce.split_by_state(o)
    n = lambda df, s: df.agg(F.lit(s).alias("state"), F.count("*").alias("n"))
    pairs = o.select(F.col("o_custkey") % 7, F.col("o_orderkey") % 5).distinct()
    return n(done, "done").union(n(left, "left")).union(n(done.unionByName(left), "all")).union(n(pairs, "partners"))


# --- sorts -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT value FROM (SELECT value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 8),
m AS (SELECT list(value ORDER BY value) AS l, len(list(value)) // 4 AS step FROM s), d AS (SELECT l[step + 1] AS a, l[2 * step + 1] AS b, l[3 * step + 1] AS c FROM m)
SELECT CAST((value > a)::INT + (value > b)::INT + (value > c)::INT AS INT) AS bucket, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events, d GROUP BY 1""")
def sample_sort(spark, sf_dir):
    """Dividers from the first eight events of each type; buckets hold the values between them."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    got = sorting.sample_sort(e, "event_type", "value", 4, order=F.col("event_id"))
    return got.groupBy("bucket").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""WITH h AS (SELECT CAST(least(63, floor(value / 7.8125e0)) AS INT) AS bin, count(*) AS c FROM events GROUP BY 1), g AS (SELECT *, sum(c) OVER (ORDER BY bin) AS cum, sum(c) OVER () AS t FROM h),
d AS (SELECT k, min(bin) * 7.8125e0 + 3.90625e0 AS edge FROM g, generate_series(1, 4) s(k) WHERE cum > t // 5 * k GROUP BY k)
SELECT CAST(b AS INT) AS bucket, count(*) AS n FROM (SELECT (SELECT count(*) FROM d WHERE edge <= value) AS b FROM events) GROUP BY 1""")
def histogram_sort(spark, sf_dir):
    got = sorting.histogram_sort(table(spark, sf_dir, "events").select("value"), "value", 0, 500, 5)
    return got.groupBy("bucket").agg(F.count("*").alias("n"))


# --- k-d trees ---------------------------------------------------------------------------------------


def kd_sql(points: str, lo: tuple[float, float], hi: tuple[float, float], dims: list[int], bins: int, divs=None, block=None, ghost=None) -> str:
    """Chained levels: histogram, cumulated counts, split, children. With divisions, bound to the ghost layers."""
    n = [f"CAST({lo[d]} AS REAL) AS lo{d}, CAST({hi[d]} AS REAL) AS hi{d}" for d in (0, 1)]
    if divs:
        n += [f"0 AS a{d}, {divs[d] - 1} AS b{d}" for d in (0, 1)]
    out = [f"p0 AS (SELECT k, x, y, 0 AS node FROM ({points}))", f"n0 AS (SELECT 0 AS node, {', '.join(n)})"]
    for i, d in enumerate(dims):
        v = "xy"[d]
        w = f"(hi{d} - lo{d}) / CAST({bins} AS REAL)"
        mid = f"(a{d} + (b{d} - a{d} + 1) // 2)" if divs else "0"
        r0, r1 = (f"greatest(lo{d}, CAST({mid} * {block[d]} - {ghost} AS REAL))", f"least(hi{d}, CAST({mid} * {block[d]} - 1 + {ghost} AS REAL))") if divs else ("NULL", "NULL")
        out.append(f"q{i} AS (SELECT *, {w} AS w, CAST({r0} AS DOUBLE) AS r0, CAST({r1} AS DOUBLE) AS r1, {mid} AS mid FROM n{i})")
        out.append(f"h{i} AS (SELECT node, bin, count(*) AS c FROM (SELECT node, greatest(0, least({bins - 1}, CAST(trunc((CAST({v} AS REAL) - lo{d}) / w) AS INT))) AS bin FROM p{i} JOIN q{i} USING (node)) GROUP BY 1, 2)")
        out.append(f"g{i} AS (SELECT h{i}.*, CAST(lo{d} + CAST(bin AS REAL) * w AS DOUBLE) AS low, r0, sum(c) OVER (PARTITION BY node ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY node) // 2 AS half FROM h{i} JOIN q{i} USING (node))")
        late = "low >= r0" if divs else "true"
        out.append(f"e{i} AS (SELECT node, sum(CASE WHEN {late} THEN 0 ELSE c END) AS skipped, min(half) AS half, min(CASE WHEN {late} AND cum > half THEN low END) AS low FROM g{i} GROUP BY 1)")
        if divs:
            raw = "CASE WHEN e.low IS NULL OR (skipped >= half AND skipped > 0) THEN r0 ELSE least(r1, e.low) END"
            cut = f"CASE WHEN s IN (lo{d}, hi{d}) THEN (r0 + r1) / 2 ELSE s END"
        else:
            raw = "e.low"
            cut = f"CASE WHEN s IS NULL OR s IN (lo{d}, hi{d}) THEN (CAST(lo{d} AS DOUBLE) + hi{d}) / 2 ELSE s END"
        out.append(f"c{i} AS (SELECT *, CAST(CAST({cut} AS REAL) AS DOUBLE) AS cut FROM (SELECT q{i}.*, {raw} AS s FROM q{i} LEFT JOIN e{i} e USING (node)))")
        out.append(f"p{i + 1} AS (SELECT k, x, y, node * 2 + ({v} >= cut)::INT AS node FROM p{i} JOIN c{i} USING (node))")
        cols = []
        for side in (0, 1):
            c = [f"node * 2 + {side} AS node"]
            for e in (0, 1):
                c += [f"CAST({'cut' if e == d and side else f'lo{e}'} AS REAL) AS lo{e}", f"CAST({'cut' if e == d and not side else f'hi{e}'} AS REAL) AS hi{e}"]
                if divs:
                    c += [f"{'mid' if e == d and side else f'a{e}'} AS a{e}", f"{'mid - 1' if e == d and not side else f'b{e}'} AS b{e}"]
            cols.append(f"SELECT {', '.join(c)} FROM c{i}")
        out.append(f"n{i + 1} AS ({' UNION ALL '.join(cols)})")
    m = len(dims)
    return f"WITH {', '.join(out)} SELECT CAST(n.node AS BIGINT) AS node, round(CAST(lo0 AS DOUBLE), 3) AS lo_x, round(CAST(hi0 AS DOUBLE), 3) AS hi_x, round(CAST(lo1 AS DOUBLE), 3) AS lo_y, round(CAST(hi1 AS DOUBLE), 3) AS hi_y, count(k) AS n FROM n{m} n LEFT JOIN p{m} p USING (node) GROUP BY ALL"


def leaf_counts(spark, points: DataFrame, nodes: list) -> DataFrame:
    leaves = spark.createDataFrame([(n.path, *(round(float(np.float32(v)), 3) for v in (n.lo[0], n.hi[0], n.lo[1], n.hi[1]))) for n in nodes], "node long, lo_x double, hi_x double, lo_y double, hi_y double")
    return leaves.join(points.groupBy("node").agg(F.count("*").alias("n")), "node", "left").fillna(0, ["n"])


def kd_points(spark, sf_dir) -> DataFrame:
    return order_points(spark, sf_dir).select("k", F.array("x", "y").alias("p"))


@query(kd_sql(POINTS, (0, 0), (48, 10), [0, 1, 0], 64))
def kd_histogram_tree(spark, sf_dir):
    """Eight leaves by histogram medians, dimensions in turn."""
    at, nodes = kdtree.histogram_tree(kd_points(spark, sf_dir), (0.0, 0.0), (48.0, 10.0), 8, 64)
    return leaf_counts(spark, at, nodes)


@query(kd_sql(POINTS, (0, 0), (49, 10), [0, 1, 0], 2048, (4, 2), (12, 5), 2))
def kd_constrained_tree(spark, sf_dir):
    """Splits bound to the ghost layers around the middle divisions."""
    at, nodes = kdtree.constrained(kd_points(spark, sf_dir), GRID8)
    return leaf_counts(spark, at, nodes)


@query(kd_sql(POINTS, (0, 0), (49, 10), [0, 1, 0], 2048))
def kd_unconstrained_tree(spark, sf_dir):
    at, nodes = kdtree.constrained(kd_points(spark, sf_dir), GRID8, bound=False)
    return leaf_counts(spark, at, nodes)


@query("""WITH b AS (SELECT i AS gid, (i >> 2 & 1) * 2 + (i & 1) AS cx, i >> 1 & 1 AS cy FROM generate_series(0, 7) t(i))
SELECT CAST(gid AS BIGINT) AS gid, CAST(cx * 12 AS INT) AS lb_x, CAST(CASE WHEN cx = 3 THEN 49 ELSE cx * 12 + 11 END AS INT) AS ub_x, CAST(cy * 5 AS INT) AS lb_y, CAST(CASE WHEN cy = 1 THEN 10 ELSE 4 END AS INT) AS ub_y FROM b""")
def kd_geometric_build(spark, sf_dir):
    """The first build, at the middle divisions: data boxes by leaf number."""
    _, nodes = kdtree.constrained(None, GRID8, first=True)
    b = kdtree.blocks_of_leaves(spark, nodes, GRID8)
    return b.select("gid", *(F.col(c)[i].alias(f"{c}_{a}") for i, a in enumerate("xy") for c in ("lb", "ub")))


@query("""WITH p0 AS (SELECT event_id AS k, value AS x, CAST(user_id AS DOUBLE) AS y FROM events),
s0 AS (SELECT list(x ORDER BY x) AS l FROM (SELECT x, row_number() OVER (ORDER BY k) AS r FROM p0) WHERE r <= 64), p1 AS (SELECT k, x, y, (x >= l[len(l) // 2 + 1])::INT AS node FROM p0, s0),
s1 AS (SELECT node, list(y ORDER BY y) AS l FROM (SELECT node, y, row_number() OVER (PARTITION BY node ORDER BY k) AS r FROM p1) WHERE r <= 64 GROUP BY 1)
SELECT CAST(p1.node * 2 + (y >= l[len(l) // 2 + 1])::INT AS BIGINT) AS node, count(*) AS n FROM p1 JOIN s1 USING (node) GROUP BY 1""")
def kd_sampling_tree(spark, sf_dir):
    """Splits at the median of each node's first 64 rows by id."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.array("value", F.col("user_id").cast("double")).alias("p"))
    at, _ = kdtree.sampling_tree(e, (0.0, 0.0), (500.0, 1e9), 4, 64, F.col("k"))
    return at.groupBy("node").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT i AS gid, (i >> 2 & 1) * 2 + (i & 1) AS cx, i >> 1 & 1 AS cy FROM generate_series(0, 7) t(i)) SELECT CAST(a.gid AS BIGINT) AS gid, CAST(b.gid AS BIGINT) AS nbr FROM b a, b
WHERE a.gid <> b.gid AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1""")
def kd_leaf_links(spark, sf_dir):
    """Leaves that touch."""
    _, nodes = kdtree.constrained(None, GRID8, first=True)
    return kdtree.leaf_links(kdtree.leaves_df(spark, nodes))


# --- neighbour queries ---------------------------------------------------------------------------------


def block_boxes(spark) -> DataFrame:
    b = GRID8.blocks(spark)
    return b.select("gid", *(F.col(f"{o}_{a}").cast("double").alias(f"{n}_{a}") for a in "xy" for n, o in (("lo", "lb"), ("hi", "ub"))))


DIST = "sqrt(pow(greatest(lb_x - x, 0, x - ub_x), 2) + pow(greatest(lb_y - y, 0, y - ub_y), 2))"
OWN = "CAST(least(3, CAST(trunc(x) AS INT) // 12) + 4 * least(1, CAST(trunc(y) AS INT) // 5) AS INT)"


@query(f"WITH {BLOCKS8}, q AS ({POINTS}) SELECT q.k, k.gid AS nbr, round({DIST}, 6) AS distance FROM q, k WHERE k.gid <> {OWN} AND {DIST} <= 1.5")
def pick_near(spark, sf_dir):
    """Orders' points and the other blocks within 1.5."""
    p = order_points(spark, sf_dir).withColumn("gid", GRID8.owner([F.col("x"), F.col("y")]))
    return pick.near(p, block_boxes(spark), ["x", "y"], 1.5).select("k", "nbr", F.round("distance", 6).alias("distance"))


@query(f"WITH {BLOCKS8}, q AS ({POINTS}) SELECT q.k, k.gid AS nbr FROM q, k WHERE k.gid <> {OWN} AND x BETWEEN lb_x - 2 AND ub_x + 2 AND y BETWEEN lb_y - 2 AND ub_y + 2")
def pick_in(spark, sf_dir):
    """Points and the other blocks whose padded boxes hold them, over the links of a complete graph."""
    p = order_points(spark, sf_dir).withColumn("gid", GRID8.owner([F.col("x"), F.col("y")]))
    b = block_boxes(spark)
    for a in "xy":
        b = b.withColumns({f"lo_{a}": F.col(f"lo_{a}") - 2, f"hi_{a}": F.col(f"hi_{a}") + 2})
    return pick.in_(p, b, ["x", "y"], GRID8.complete_links(spark)).select("k", "nbr")


@query(f"""WITH {BLOCKS8} SELECT a.gid, b.gid AS nbr, round(sqrt(pow(greatest(a.lb_x - b.ub_x, 0, b.lb_x - a.ub_x), 2) + pow(greatest(a.lb_y - b.ub_y, 0, b.lb_y - a.ub_y), 2)), 6) AS distance FROM k a, k b WHERE a.gid < b.gid""")
def box_distances(spark, sf_dir):
    return pick.box_distances(block_boxes(spark), ["x", "y"]).select("gid", "nbr", F.round("distance", 6).alias("distance"))


# --- metrics -------------------------------------------------------------------------------------------


def line_work(spark, sf_dir) -> DataFrame:
    """Work by round and worker, made of line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("round"), (F.col("l_suppkey") % 16).alias("gid")).agg(F.count("*").alias("steps"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("finished"))


WORK = "w AS (SELECT l_linenumber AS round, l_suppkey % 16 AS gid, count(*) AS steps, count_if(l_returnflag = 'R') AS finished FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {WORK}, r AS (SELECT round, max(steps) AS max, avg(steps) AS avg, sum(steps) AS total, count(*) AS workers FROM w GROUP BY 1)
SELECT round, max, round(avg, 6) AS avg, CAST(total AS BIGINT) AS total, workers, round(max / avg, 6) AS balance, round((max - avg) / max, 6) AS imbalance, CAST(sum(max) OVER (ORDER BY round) AS BIGINT) AS cum_max FROM r""")
def round_balance(spark, sf_dir):
    b = metrics.round_balance(line_work(spark, sf_dir))
    return b.withColumns({c: F.round(c, 6) for c in ("avg", "balance", "imbalance")})


@query(f"""WITH {WORK}, m AS (SELECT sum(m) AS max_work FROM (SELECT max(steps) AS m FROM w GROUP BY round)), a AS (SELECT avg(s) AS mean_work, sum(s) AS total_steps, count(*) AS workers FROM (SELECT sum(steps) AS s FROM w GROUP BY gid))
SELECT CAST(max_work AS BIGINT) AS max_work, round(mean_work, 6) AS mean_work, CAST(total_steps AS BIGINT) AS total_steps, workers, round(max_work / mean_work, 6) AS load_balance FROM m, a""")
def load_balance(spark, sf_dir):
    b = metrics.load_balance(line_work(spark, sf_dir))
    return b.withColumns({c: F.round(c, 6) for c in ("mean_work", "load_balance")})


@query(f"WITH {WORK} SELECT gid, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(finished) AS BIGINT) AS finished FROM w GROUP BY 1")
def worker_loads(spark, sf_dir):
    return metrics.workload(line_work(spark, sf_dir), "gid")


@query("SELECT user_id AS worker, seq, CAST(secs - prior AS BIGINT) AS dt FROM (SELECT user_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS secs, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events) WHERE prior IS NOT NULL")
def timeline_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"))
    return metrics.timeline_deltas(e).select("worker", "seq", "dt")


@query("""WITH p AS (SELECT event_id, value * 0.6e0 AS x0, (user_id % 180) + 0.5e0 AS y0, (value * 0.6e0) + 3.25e0 AS x1, (user_id % 178) + 1.25e0 AS y1 FROM events),
q AS (SELECT *, greatest(-180, least(180, x0 * (360e0 / 287) - 180)) AS a0, greatest(-90, least(90, y0 - 90)) AS b0, greatest(-180, least(180, x1 * (360e0 / 287) - 180)) AS a1, greatest(-90, least(90, y1 - 90)) AS b1 FROM p),
r AS (SELECT *, pow(sin((radians(b1) - radians(b0)) / 2), 2) + cos(radians(b0)) * cos(radians(b1)) * pow(sin(radians(a1 - a0) / 2), 2) AS a FROM q)
SELECT event_id, round(CASE WHEN x1 > 287 THEN x1 - 287 WHEN x1 < 0 THEN x1 + 287 ELSE x1 END, 6) AS wrapped, round(6371000e0 * 2 * atan2(sqrt(a), sqrt(1 - a)), 2) AS metres FROM r""")
def great_circles(spark, sf_dir):
    """Haversine distances on the longitude-latitude grid, and the periodic wrap."""
    e = table(spark, sf_dir, "events")
    x0, y0 = F.col("value") * 0.6, F.col("user_id") % 180 + 0.5
    x1, y1 = F.col("value") * 0.6 + 3.25, F.col("user_id") % 178 + 1.25
    return e.select("event_id", F.round(G.wrap_x(x1), 6).alias("wrapped"), F.round(G.haversine(x0, y0, x1, y1), 2).alias("metres"))


# --- stores and read plans ---------------------------------------------------------------------------


@query("SELECT gid, count, CAST(sum(count) OVER (ORDER BY gid) - count AS BIGINT) AS offset FROM (SELECT CAST(event_id % 16 AS BIGINT) AS gid, count(*) AS count FROM events GROUP BY 1)")
def block_footer(spark, sf_dir):
    return block_store.footer(table(spark, sf_dir, "events").select((F.col("event_id") % 16).alias("gid")))


REQUESTS = "SELECT n_nationkey AS id, 'f' || n_regionkey AS file, 'u' AS var, n_nationkey * 3 % 20 AS s0, n_nationkey * 5 % 17 AS s1, n_nationkey * 3 % 20 + 6 AS e0, n_nationkey * 5 % 17 + 4 AS e1 FROM nation"


@query(f"""WITH r AS ({REQUESTS}), g AS (SELECT file, var, min(s0) AS a0, min(s1) AS a1, max(e0) AS b0, max(e1) AS b1 FROM r GROUP BY 1, 2),
b AS (SELECT file, var, i, a0 + (b0 - a0) * i // 2 AS i0, a0 + (b0 - a0) * (i + 1) // 2 AS j0, a1 AS i1, b1 AS j1 FROM g, generate_series(0, 1) t(i))
SELECT r.id, file, CAST(greatest(s0, i0) AS INT) AS s0, CAST(least(e0, j0) AS INT) AS e0, CAST(greatest(s1, i1) AS INT) AS s1, CAST(least(e1, j1) AS INT) AS e1 FROM r JOIN b USING (file, var) WHERE greatest(s0, i0) < least(e0, j0) AND greatest(s1, i1) < least(e1, j1)""")
def read_exchange(spark, sf_dir):
    """Boxes asked for, against the boxes that ten readers read of five files: what goes where."""
    k = F.col("n_nationkey").cast("int")
    a0, a1 = k * 3 % 20, k * 5 % 17
    r = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("file"), F.lit("u").alias("var"), F.array(a0, a1).alias("start"), F.array(a0 + 6, a1 + 4).alias("end")
    )
    got = read_plan.exchange_plan(r, read_plan.io_blocks(r, 2, 10), 2)
    part = lambda c, i, n: F.col(c)[i].alias(n)
    return got.select("id", "file", part("part_start", 0, "s0"), part("part_end", 0, "e0"), part("part_start", 1, "s1"), part("part_end", 1, "e1"))


assert AXES == "xyzt"

from gridtrace import catalog_io, catalog_kernels  # noqa: E402, F401  they add their queries to those above
