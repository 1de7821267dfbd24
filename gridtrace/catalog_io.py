"""Queries over files, stores, sinks, exchanges, periodic grids and streams, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtrace.catalog import BLOCKS8, FIELD, GRID8, SIZE, WORK, field_array, line_field, line_work, order_points, query, table
from gridtrace.functions import geometry as G
from gridtrace.operators import kdtree, metrics, reduce, sorting
from gridtrace.plans import grid as gr
from gridtrace.plans.grid import Grid
from gridtrace.session import new_path
from gridtrace.sources import block_store, fields, netcdf, raw, read_plan
from gridtrace.streaming import events as stream

# --- field files: written to the shared folder, read back by the sources -----------------------------


def local(path: str) -> str:
    """For readers that seek in files of a mounted folder."""
    return path.removeprefix("file://")


def write_field(spark, sf_dir: str) -> str:
    """The line items' field as a NetCDF file: its size is the grid's, whatever the table's."""
    path = new_path(spark, "field") + "/field.nc"
    data = field_array(spark, sf_dir)
    netcdf.write(path, [("y", SIZE[1]), ("x", SIZE[0])], {n: (["y", "x"], data[i]) for i, n in enumerate("uv")})
    netcdf.register(spark)
    return path


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {FIELD} SELECT x, y, round(u, 6) AS u, round(v, 6) AS v FROM f WHERE x BETWEEN 10 AND 30 AND y > 3")
def scan_netcdf(spark, sf_dir):
    """A hyperslab of two variables; the bounds are pushed to the scan."""
    df = spark.read.format("netcdf").load(write_field(spark, sf_dir))
    return rounded(df.where("x >= 10 AND x <= 30 AND y > 3"), "u", "v")


@query(f"WITH {FIELD} SELECT x, y, round(u, 6) AS u, round(v, 6) AS v FROM f")
def scan_variables_joined(spark, sf_dir):
    """A scan for each variable, joined on the coordinates."""
    path = write_field(spark, sf_dir)
    return rounded(fields.join_variables([spark.read.format("netcdf").option("variables", n).load(path) for n in "uv"], ["x", "y"]), "u", "v")


@query(f"WITH {FIELD} SELECT f.x, f.y, CAST(z AS INT) AS z, CAST(t AS INT) AS t, round(u + 10 * z + 100 * t, 6) AS u FROM f, generate_series(0, 2) a(z), generate_series(0, 4) b(t) WHERE t BETWEEN 1 AND 3 AND z < 2")
def scan_netcdf_4d(spark, sf_dir):
    """Four dimensions over two files, joined along time, with time and height pushed down."""
    u, base = field_array(spark, sf_dir)[0], new_path(spark, "field")
    for k, ts in enumerate(((0, 1), (2, 3, 4))):
        data = np.stack([np.stack([u + 10 * z + 100 * t for z in range(3)]) for t in ts])
        netcdf.write(f"{base}/part{k}.nc", [("t", len(ts)), ("z", 3), ("y", SIZE[1]), ("x", SIZE[0])], {"u": (["t", "z", "y", "x"], data)}, record_dim="t")
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("path", f"{base}/part0.nc,{base}/part1.nc").load()
    return rounded(df.where("t >= 1 AND t <= 3 AND z < 2"), "u")


@query(f"WITH {FIELD} SELECT x, y, cnt AS value FROM f WHERE y BETWEEN 2 AND 5")
def scan_raw(spark, sf_dir):
    """Counts as a raw array, written from the executors by blocks into one file and scanned by slabs."""
    path = new_path(spark, "raw") + "/counts.raw"
    import os

    os.makedirs(os.path.dirname(local(path)), exist_ok=True)

    def cut(key, g):
        import pandas as pd

        lo, hi = GRID8.core(int(key[0]))
        out = np.zeros((hi[1] - lo[1] + 1, hi[0] - lo[0] + 1), dtype="<i8")
        out[g["y"] - lo[1], g["x"] - lo[0]] = g["cnt"]
        return pd.DataFrame({"gid": [key[0]], "start": [[lo[1], lo[0]]], "shape": [list(out.shape)], "data": [out.tobytes()]})

    f = line_field(spark, sf_dir).select(GRID8.owner([F.col("x"), F.col("y")]).alias("gid"), "x", "y", "cnt")
    bricks = f.groupBy("gid").applyInPandas(cut, "gid int, start array<int>, shape array<int>, data binary")
    raw.write_bricks(bricks, local(path), (SIZE[1], SIZE[0]), "<i8")
    raw.register(spark)
    return spark.read.format("brick").option("shape", f"{SIZE[1]},{SIZE[0]}").option("dtype", "<i8").load(local(path)).where("y BETWEEN 2 AND 5")


@query("SELECT CAST(j AS INT) AS y, CAST(i AS INT) AS x, CASE WHEN i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2 THEN CAST(i + 16 * j AS DOUBLE) ELSE 0 END AS value FROM generate_series(0, 15) a(i), generate_series(0, 15) b(j)")
def scan_core_box(spark, sf_dir):
    """The core of a 4 x 4 buffer written into a 16 x 16 .npy file of zeros."""
    import os

    path = local(new_path(spark, "npy")) + "/core.npy"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    head = raw.npy_header_bytes((16, 16), "<f8")
    raw.create(path, (16, 16), "<f8", head)
    buffer = np.add.outer(16.0 * np.arange(4), np.arange(4.0))
    raw.write_box(path, (16, 16), (1, 1), buffer, core=((1, 1), (2, 2)), header=len(head))
    raw.register(spark)
    return spark.read.format("brick").load(path)


@query(f"WITH {FIELD} SELECT x, y, round(u, 6) AS value FROM f WHERE x < 7")
def scan_npy(spark, sf_dir):
    """A .npy file of the field, written by two boxes; its shape and type are in the header."""
    import os

    path, u = local(new_path(spark, "npy")) + "/u.npy", field_array(spark, sf_dir)[0]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raw.write_npy(path, u.shape, "<f8", [((0, 0), u[:, :20]), ((0, 20), u[:, 20:])])
    raw.register(spark)
    return rounded(spark.read.format("brick").load(path).where("x < 7"), "value")


@query("SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(k AS INT) AS z, CAST(i AS FLOAT) AS u, CAST(j * 10 AS FLOAT) AS v, CAST(k * 100 AS FLOAT) AS w FROM generate_series(0, 7) a(i), generate_series(0, 7) b(j), generate_series(0, 7) c(k)")
def convert_interleaved(spark, sf_dir):
    """Interleaved big-endian values of three variables, converted to one variable each."""
    import os

    base = local(new_path(spark, "convert"))
    os.makedirs(base, exist_ok=True)
    z, y, x = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    np.stack([x, y * 10, z * 100], axis=-1).astype(">f4").tofile(f"{base}/in.raw")
    raw.convert(f"{base}/in.raw", f"{base}/out.nc", (8, 8, 8), ["u", "v", "w"])
    netcdf.register(spark)
    return spark.read.format("netcdf").load(f"{base}/out.nc")


@query(f"""WITH {FIELD}, r AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN 'u' ELSE 'v' END AS var, n_nationkey % 7 AS y0, n_nationkey * 5 % 37 AS x0 FROM nation)
SELECT id, count(*) AS cells, round(sum(CASE WHEN var = 'u' THEN u ELSE v END), 6) AS total FROM r JOIN f ON f.y >= y0 AND f.y < y0 + 4 AND f.x >= x0 AND f.x < x0 + 9 GROUP BY id""")
def collective_read(spark, sf_dir):
    """Two phases: each reader's box is read once, cut, and handed to the requests that asked for it."""
    path, k = write_field(spark, sf_dir), F.col("n_nationkey").cast("int")
    y0, x0 = k % 7, k * 5 % 37
    requests = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit(path).alias("file"), F.when(F.col("n_regionkey") < 3, "u").otherwise("v").alias("var"), F.array(y0, x0).alias("start"), F.array(y0 + 4, x0 + 9).alias("end")
    )

    def read(file, var, start, size):
        with netcdf._open(file) as f:
            return netcdf.read_box(f, netcdf.read_header(f), var, start, size)

    def add(batches):
        for b in batches:
            data = [np.frombuffer(r.data, dtype=r.dtype).astype(float) for r in b.itertuples()]
            yield b[["id"]].assign(cells=[len(d) for d in data], total=[round(float(d.sum()), 6) for d in data])

    return read_plan.read_boxes(requests, 2, 6, read).mapInPandas(add, "id long, cells long, total double")


@query("""WITH r AS (SELECT CASE WHEN n_regionkey < 3 THEN 'u' ELSE 'v' END AS var, n_nationkey % 7 AS y0, n_nationkey * 5 % 37 AS x0 FROM nation),
g AS (SELECT var, max(y0) + 4 - min(y0) AS ny, max(x0) + 9 - min(x0) AS nx FROM r GROUP BY 1)
SELECT var, CAST(3 AS BIGINT) AS boxes, CAST(3 AS BIGINT) AS readers, CAST(ny * nx * 8 AS BIGINT) AS bytes_read FROM g""")
def io_counters(spark, sf_dir):
    """What six readers read of two variables; seconds are left out, as they differ from run to run."""
    path, k = write_field(spark, sf_dir), F.col("n_nationkey").cast("int")
    y0, x0 = k % 7, k * 5 % 37
    requests = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.lit(path).alias("file"), F.when(F.col("n_regionkey") < 3, "u").otherwise("v").alias("var"), F.array(y0, x0).alias("start"), F.array(y0 + 4, x0 + 9).alias("end")
    )

    def read(file, var, start, size):
        with netcdf._open(file) as f:
            return netcdf.read_box(f, netcdf.read_header(f), var, start, size)

    got = metrics.io_counters(read_plan.timed_reads(requests, 2, 6, read), ("var",))
    return got.where("io_seconds > 0 AND slowest <= io_seconds").select("var", "boxes", "readers", "bytes_read")


# --- memory of ghosted blocks, and probes of how far they may grow ---------------------------------------

GHOSTED = f"""{BLOCKS8}, t AS (SELECT CAST(j AS INT) AS j, CAST(1 + (j + 1) // 2 AS INT) AS gx, CAST(1 + j // 2 AS INT) AS gy FROM generate_series(0, 99) s(j)),
n AS (SELECT j, gx, gy, least(49, ub_x + gx) - greatest(0, lb_x - gx) + 1 AS nx, least(10, ub_y + gy) - greatest(0, lb_y - gy) + 1 AS ny FROM k, t),
m AS (SELECT j, gx, gy, CAST(sum(nx * ny) * 8 AS BIGINT) AS bytes, bool_or(nx = 50 AND ny = 11) AS whole FROM n GROUP BY 1, 2, 3)"""


@query(f"WITH {GHOSTED} SELECT gx, gy, bytes, whole FROM m WHERE j % 9 = 0")
def block_memory(spark, sf_dir):
    """Bytes of all blocks by ghost layers, and whether a block holds the whole domain."""
    rows = [(1 + (j + 1) // 2, 1 + j // 2) for j in range(0, 100, 9)]
    return spark.createDataFrame([(*g, *Grid.of(SIZE, 8, g).memory(2)) for g in rows], "gx int, gy int, bytes long, whole boolean")


@query(f"WITH {GHOSTED}, l AS (SELECT kb FROM (VALUES (1), (6), (9), (14), (22), (30), (1000)) v(kb)), f AS (SELECT kb, min(j) AS j FROM l, m WHERE bytes > kb * 1024 OR whole GROUP BY 1) SELECT kb, gx, gy FROM f JOIN m USING (j)")
def ghosts_by_turns(spark, sf_dir):
    """Ghost layers that grow in one dimension after another, by limits of memory."""
    return spark.createDataFrame([(kb, *gr.ghosts_by_turns(Grid.of(SIZE, 8, 1), kb * 1024, 2)) for kb in (1, 6, 9, 14, 22, 30, 1000)], "kb int, gx int, gy int")


@query("""WITH p AS (SELECT * FROM (VALUES (2, 1, 0, 0), (4, 1, 1, 0), (8, 1, 1, 1)) t(procs, dx, dy, dz)), l AS (SELECT * FROM (VALUES (512), (1024), (2000)) t(limit_mb)),
s AS (SELECT procs, limit_mb, i, CASE WHEN dx = 1 THEN least(512, 257 + i) ELSE 512 END AS nx, CASE WHEN dy = 1 THEN least(512, 257 + i) ELSE 512 END AS ny, CASE WHEN dz = 1 THEN least(512, 257 + i) ELSE 512 END AS nz
  FROM p, l, generate_series(0, 300) g(i))
SELECT procs, limit_mb, CAST(arg_min(nx, i) AS INT) AS nx, CAST(arg_min(ny, i) AS INT) AS ny, CAST(arg_min(nz, i) AS INT) AS nz FROM s
WHERE 257 + i >= 512 OR CAST(nx AS BIGINT) * ny * nz * 12 > CAST(limit_mb AS BIGINT) * 1048576 GROUP BY 1, 2""")
def elastic_block_sizes(spark, sf_dir):
    """Block sizes that grow until their memory is used, on 512 vertices a side and three variables."""
    rows = [(n, m, *gr.elastic_block_size((512,) * 3, n, n, m, 3)) for n in (2, 4, 8) for m in (512, 1024, 2000)]
    return spark.createDataFrame(rows, "procs int, limit_mb int, nx int, ny int, nz int")


# --- block stores -------------------------------------------------------------------------------------

STORE = "SELECT CAST(event_id % 16 AS INT) AS gid, event_id, user_id FROM events"


def _store(spark, sf_dir, split: bool) -> str:
    path = new_path(spark, "store")
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 16).cast("int").alias("gid"), "event_id", "user_id")
    block_store.write_blocks(e, path, {"made by": "events"}, split)
    return path


@query(f"SELECT CAST(gid % 3 AS INT) AS rank, gid, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM ({STORE}) GROUP BY 1, 2")
def store_shared(spark, sf_dir):
    """Blocks of one table, read by another number of ranks than wrote them."""
    blocks, _, _ = block_store.read_blocks(spark, _store(spark, sf_dir, False), n_ranks=3)
    return blocks.groupBy("rank", "gid").agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


@query(f"SELECT gid, event_id, user_id, 'events' AS made FROM ({STORE}) WHERE gid IN (3, 11)")
def store_split(spark, sf_dir):
    """A folder for each block: two of them are read, with what the store says of itself."""
    blocks, _, extra = block_store.read_blocks(spark, _store(spark, sf_dir, True), gids=[3, 11])
    return blocks.select(F.col("gid").cast("int").alias("gid"), "event_id", "user_id", F.lit(extra["made by"]).alias("made"))


@query(f"WITH c AS (SELECT gid, count(*) AS count FROM ({STORE}) GROUP BY 1) SELECT e.gid, event_id, CAST(o AS BIGINT) AS offset FROM ({STORE}) e JOIN (SELECT gid, sum(count) OVER (ORDER BY gid) - count AS o FROM c) f ON e.gid = f.gid")
def store_footer_join(spark, sf_dir):
    """Rows and where their block begins, by the footer."""
    blocks, footer, _ = block_store.read_blocks(spark, _store(spark, sf_dir, False))
    return blocks.join(footer.select("gid", "offset"), "gid").select("gid", "event_id", "offset")


# --- periodic grids and other decompositions ----------------------------------------------------------

WRAPPED = Grid.of(SIZE, 8, 2, wrap=(True, False))


@query(f"WITH {BLOCKS8}, {FIELD} SELECT k.gid, count(*) AS vertices, CAST(sum(f.cnt) AS BIGINT) AS items, CAST(min(f.x + s) AS INT) AS lo_x, CAST(max(f.x + s) AS INT) AS hi_x FROM k, f, (VALUES (-50), (0), (50)) t(s) WHERE f.x + s BETWEEN k.lb_x - 2 AND k.ub_x + 2 AND f.y BETWEEN k.lb_y - 2 AND k.ub_y + 2 GROUP BY 1")
def ghost_replication_wrap(spark, sf_dir):
    """Vertices by block on a grid periodic in x, over the seam too."""
    f = line_field(spark, sf_dir).select("cnt", F.explode(WRAPPED.placements([F.col("x"), F.col("y")])).alias("p")).select("p.gid", "p.x", "cnt")
    return f.groupBy("gid").agg(F.count("*").alias("vertices"), F.sum("cnt").alias("items"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"))


@query(f"WITH {BLOCKS8}, {FIELD} SELECT k.gid, CAST((k.ub_x - k.lb_x + 5) * (least(10, k.ub_y + 2) - greatest(0, k.lb_y - 2) + 1) AS BIGINT) AS cells, round(sum(f.u), 6) AS total FROM k, f, (VALUES (-50), (0), (50)) t(s) WHERE f.x + s BETWEEN k.lb_x - 2 AND k.ub_x + 2 AND f.y BETWEEN k.lb_y - 2 AND k.ub_y + 2 GROUP BY ALL")
def bricks_wrap(spark, sf_dir):
    """Bricks of the periodic grid: no vertex is missing over the seam."""

    def add(batches):
        for b in batches:
            data = [np.frombuffer(r.data, dtype=r.dtype) for r in b.itertuples()]
            yield b[["gid"]].assign(cells=[len(d) for d in data], total=[round(float(d.sum()), 6) for d in data])

    return fields.to_bricks(line_field(spark, sf_dir), WRAPPED, ["u"], "float64").mapInPandas(add, "gid int, cells long, total double")


@query("""WITH b AS (SELECT i AS gid, (i >> 2 & 1) * 2 + (i & 1) AS cx, i >> 1 & 1 AS cy FROM generate_series(0, 7) t(i)), s AS (SELECT sx, sy FROM generate_series(-1, 1) p(sx), generate_series(-1, 1) q(sy))
SELECT CAST(a.gid AS BIGINT) AS gid, CAST(b.gid AS BIGINT) AS nbr, CAST(sx AS INT) AS wrap_x, CAST(sy AS INT) AS wrap_y FROM b a, b, s WHERE abs(a.cx - b.cx - 4 * sx) <= 1 AND abs(a.cy - b.cy - 2 * sy) <= 1 AND (a.gid <> b.gid OR sx <> 0 OR sy <> 0)""")
def kd_leaf_links_periodic(spark, sf_dir):
    """Leaves that touch, over the seams too, and in which direction."""
    _, nodes = kdtree.constrained(None, GRID8, first=True)
    links = kdtree.leaf_links(kdtree.leaves_df(spark, nodes), [float(s - 1) for s in SIZE])
    return links.select("gid", "nbr", F.col("wrap")[0].alias("wrap_x"), F.col("wrap")[1].alias("wrap_y"))


@query("""SELECT CAST(i AS INT) AS block, CAST(i * 7 AS INT) AS lo, CAST(CASE WHEN i = 6 THEN 49 ELSE i * 7 + 7 END AS INT) AS hi FROM generate_series(0, 6) t(i)""")
def shared_faces(spark, sf_dir):
    """Cores whose last layer is the next one's first."""
    return spark.createDataFrame([(i, *gr.core_1d(i, 7, 0, 49, shared_face=True)) for i in range(7)], "block int, lo int, hi int")


@query("""SELECT CAST(i AS INT) AS block, round(1000e0 / 9 * i, 6) AS lo, round(1000e0 / 9 * (i + 1), 6) AS hi FROM generate_series(0, 8) t(i)""")
def continuous_cores(spark, sf_dir):
    return rounded(spark.createDataFrame([(i, *map(float, gr.core_1d(i, 9, 0.0, 1000.0, continuous=True))) for i in range(9)], "block int, lo double, hi double"), "lo", "hi")


@query("""WITH q AS (SELECT o_orderkey AS k, o_totalprice / 10500e0 AS x, CAST(o_orderkey % 1000 AS DOUBLE) / 100 AS y FROM orders)
SELECT CAST(least(3, CAST(trunc(x) AS INT) // 12) + 4 * least(1, CAST(trunc(y) AS INT) // 5) AS INT) AS gid, CAST((CAST(trunc(x) AS BIGINT) + 50 * CAST(trunc(y) AS BIGINT)) AS BIGINT) AS id, count(*) AS n FROM q GROUP BY 1, 2""")
def linear_ids(spark, sf_dir):
    """Points by block and linear vertex index."""
    p = order_points(spark, sf_dir)
    at = [F.floor("x"), F.floor("y")]
    return p.groupBy(GRID8.owner([F.col("x"), F.col("y")]).alias("gid"), gr.linear_id(at, SIZE).alias("id")).agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT o_orderkey AS k, o_totalprice / 10500e0 AS x, CAST(o_orderkey % 1000 AS DOUBLE) / 100 AS y FROM orders), {BLOCKS8}
SELECT k.gid, count(*) AS n, CAST(count_if(x >= greatest(0, lb_x - 2) AND x < least(49, ub_x + 2) AND y >= greatest(0, lb_y - 2) AND y < least(10, ub_y + 2)) AS BIGINT) AS in_ghost,
CAST(count_if(lb_x - 2 <= x + 51 AND x + 50 <= ub_x + 2 OR lb_x - 2 <= x + 1 AND x <= ub_x + 2 OR lb_x - 2 <= x - 49 AND x - 50 <= ub_x + 2) AS BIGINT) AS meets FROM q, k GROUP BY 1""")
def block_predicates(spark, sf_dir):
    """By block: the points in its ghosted box, and the intervals [x, x + 1] that meet its x bounds on a circle of 50."""
    q, b = order_points(spark, sf_dir), GRID8.blocks(spark)
    df = q.join(F.broadcast(b))  # as many rows as points and eight blocks
    x, y, lo, hi = F.col("x"), F.col("y"), F.col("lb_x") - 2, F.col("ub_x") + 2
    start = [F.col(f"glb_{a}") for a in "xy"]
    size = [F.col(f"gub_{a}") - F.col(f"glb_{a}") + 1 for a in "xy"]
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return df.groupBy("gid").agg(F.count("*").alias("n"), n(G.in_ghost([x, y], start, size), "in_ghost"), n(G.intersects(lo, hi, x, x + 1, 50.0), "meets"))


@query("SELECT event_id, upper(printf('%08x%08x', (user_id + 4294967296) % 4294967296, (CAST(floor(value) AS BIGINT) - 250 + 4294967296) % 4294967296)) AS key, CAST(user_id AS INT) AS a, CAST(floor(value) - 250 AS INT) AS b FROM events")
def point_keys(spark, sf_dir):
    """Points as binary keys, and the way back."""
    e = table(spark, sf_dir, "events").select("event_id", G.point_key([F.col("user_id"), F.floor("value") - 250]).alias("k"))
    a, b = G.point_from_key(F.col("k"), 2)
    return e.select("event_id", F.hex("k").alias("key"), a.alias("a"), b.alias("b"))


@query("SELECT event_id, isnan(m) OR isinf(m) AS none, lo, hi FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('infinity' AS DOUBLE) ELSE value END AS m, value + (event_id % 3 - 1) * 500 AS lo, value + 1 + (event_id % 3 - 1) * 500 AS hi FROM events)")
def values_and_bounds(spark, sf_dir):
    """Which magnitudes are no value, and bounds moved over a seam."""
    k, v = F.col("event_id"), F.col("value")
    m = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).otherwise(v)
    lo, hi = G.wrap_bounds(v, v + 1, k % 3 - 1, 500.0)
    return table(spark, sf_dir, "events").select("event_id", G.no_value(m).alias("none"), lo.alias("lo"), hi.alias("hi"))


# --- exchanges and reductions -------------------------------------------------------------------------


@query("SELECT CAST((s_suppkey * 7) % 25 AS BIGINT) AS gid, count(*) AS n, count(DISTINCT s_nationkey) AS sources, CAST(1 AS BIGINT) AS partitions FROM supplier GROUP BY 1")
def exchange_blocks(spark, sf_dir):
    """What is enqueued to a block lies in one partition, its own, whoever sent it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("gid"), ((F.col("s_suppkey") * 7) % 25).alias("dst"))
    got = reduce.exchange(s, "dst").withColumn("part", F.spark_partition_id())
    return got.groupBy("gid").agg(F.count("*").alias("n"), F.countDistinct("src_gid").alias("sources"), F.countDistinct("part").alias("partitions"))


@query("SELECT CAST(event_id % 8 AS BIGINT) AS dst, count(*) AS n, list_sort(list(DISTINCT user_id % 4))::VARCHAR AS sources, CAST(1 AS BIGINT) AS partitions FROM events GROUP BY 1")
def all_to_all_rows(spark, sf_dir):
    """Variable-length records to where they are for."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("src"), (F.col("event_id") % 8).alias("dst"))
    got = reduce.all_to_all(e, "dst", 8).withColumn("part", F.spark_partition_id())
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_set("src")), lambda v: v.cast("string")), ", "), F.lit("]"))
    return got.groupBy("dst").agg(F.count("*").alias("n"), listed.alias("sources"), F.countDistinct("part").alias("partitions"))


@query("""SELECT CAST(least(3, CAST(trunc(x) AS INT) // 25) + 4 * least(2, CAST(trunc(y) AS INT) // 33) AS INT) AS gid, count(*) AS n, CAST(min(x) AS BIGINT) AS lo, CAST(max(y) AS BIGINT) AS hi FROM (SELECT event_id * 37 % 100 AS x, user_id % 100 AS y FROM events) GROUP BY 1""")
def swap_points(spark, sf_dir):
    """Points swapped in rounds of pairs and triples until each is in the block that holds it."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 37 % 100).alias("x"), (F.col("user_id") % 100).alias("y"))
    got = reduce.swap_reduce(e, ["x", "y"], (4, 3), (100, 100), 3)
    return got.groupBy(F.col("gid").cast("int").alias("gid")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("y").alias("hi"))


@query("SELECT n_nationkey, (SELECT max(r_regionkey) FROM region) AS top FROM nation")
def broadcast_root(spark, sf_dir):
    """A root's one row on every block's."""
    root = table(spark, sf_dir, "region").agg(F.max("r_regionkey").alias("top"))
    return reduce.broadcast_value(table(spark, sf_dir, "nation").select("n_nationkey"), root)


@query("""WITH p(blocks, round, size, step) AS (VALUES (8, 0, 2, 1), (8, 1, 2, 2), (8, 2, 2, 4), (12, 0, 2, 1), (12, 1, 2, 2), (12, 2, 3, 4))
SELECT blocks, round, CAST(gid AS INT) AS gid, CAST(gid - (gid // step % size) * step + m * step AS INT) AS partner FROM p, generate_series(0, 11) g(gid), generate_series(0, 2) h(m) WHERE gid < blocks AND m < size""")
def reduction_partners(spark, sf_dir):
    """Who meets whom in each round of a tree of twos."""
    rows = [(n, r, g, m) for n in (8, 12) for r, (size, step) in enumerate(reduce.partners(n, 2)) for g in range(n) for m in reduce.group_members(g, size, step)]
    return spark.createDataFrame(rows, "blocks int, round int, gid int, partner int")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) AS BIGINT) AS place FROM events")
def range_sorted(spark, sf_dir):
    """Places in a sort over all blocks: partitions hold ranges, in order."""
    got = sorting.global_sort(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")
    return reduce.scan(got.withColumn("one", F.lit(1).cast("long")), "one", ["value", "event_id"], name="place").select("event_id", "place")


# --- sinks, logs and summaries ------------------------------------------------------------------------

STAMPS = "SELECT CAST(user_id % 8 AS BIGINT) AS worker, event_id AS seq, CAST(user_id // 8 % 4 AS INT) AS category, CAST(event_id % 16 AS DOUBLE) / 8 AS dt FROM events"


def stamps(spark, sf_dir) -> DataFrame:
    u, k = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select((u % 8).alias("worker"), k.alias("seq"), (F.floor(u / 8) % 4).cast("int").alias("category"), ((k % 16).cast("double") / 8).alias("dt"))


@query(f"SELECT worker, category, count(*) AS n, sum(dt) AS seconds FROM ({STAMPS}) GROUP BY 1, 2")
def sink_timeline(spark, sf_dir):
    """The text time line, a line for each worker, written and read back."""
    path = new_path(spark, "timeline")
    metrics.write_timeline(stamps(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.split("value", "\t").alias("l"))
    entry = lines.select(F.col("l")[0].cast("long").alias("worker"), F.explode(F.split(F.col("l")[1], ",")).alias("e")).select("worker", F.split("e", ":").alias("e"))
    return entry.groupBy("worker", F.col("e")[0].cast("int").alias("category")).agg(F.count("*").alias("n"), F.sum(F.col("e")[1].cast("double")).alias("seconds"))


@query(f"WITH {WORK}, r AS (SELECT round, max(steps) / avg(steps) AS b FROM w GROUP BY 1) SELECT CAST(round AS DOUBLE) AS seconds, round(b, 6) AS balance FROM r")
def sink_balance(spark, sf_dir):
    """The balance sink, a line for each round, written and read back."""
    path = new_path(spark, "balance")
    metrics.write_balance(metrics.round_balance(line_work(spark, sf_dir)).withColumn("at", F.col("round").cast("double")), "at", path)
    part = F.split("value", ":")
    return spark.read.text(path).select(part[0].cast("double").alias("seconds"), F.round(part[1].cast("double"), 6).alias("balance"))


@query("SELECT CAST(s_nationkey AS INT) AS processes, CAST(sum(s_suppkey) AS DOUBLE) / 4 AS time_run FROM supplier GROUP BY 1")
def log_times(spark, sf_dir):
    """Run times from logs: a file for each number of processes, with other lines around."""
    base = new_path(spark, "logs")

    def put(batches):
        from pyarrow import fs

        for b in batches:
            for r in b.itertuples():
                system, p = fs.FileSystem.from_uri(f"{base}/run_{r.n}.log")
                system.create_dir(p.rpartition("/")[0], recursive=True)
                with system.open_output_stream(p) as f:
                    f.write(f"reading\ntime_run= {r.total / 4}\nSUMMARY\n".encode())
            yield b[["n"]]

    logs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.sum("s_suppkey").alias("total"))
    logs.mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()
    return metrics.parse_logs(spark, base).select("processes", "time_run")


@query(f"""WITH s AS (SELECT {', '.join(f'coalesce(sum(dt) FILTER (WHERE category = {c}), 0) / 8 AS {n}' for c, n in enumerate(('io', 'trace', 'wait', 'kd')))} FROM ({STAMPS}))
SELECT 1000e0 AS time_run, round(1000 - kd, 6) AS time_pure_run, round(1000 - kd - trace, 6) AS time_idle, round(io, 6) AS avg_time_io, round(trace, 6) AS avg_time_trace, round(wait, 6) AS avg_time_wait, round(kd, 6) AS avg_time_kdtree,
round(io / (1000 + io), 6) AS share_io, round(trace / (1000 + io), 6) AS share_trace, round(wait / (1000 + io), 6) AS share_wait, round(kd / (1000 + io), 6) AS share_kdtree FROM s""")
def time_summary(spark, sf_dir):
    got = metrics.time_summary(stamps(spark, sf_dir), 1000.0, 8)
    return spark.createDataFrame([{k: round(float(v), 6) for k, v in got.items()}])


@query("""WITH s AS (SELECT max(s_suppkey) AS a, CAST(sum(s_suppkey) AS BIGINT) AS b FROM supplier) SELECT 0 AS line, 'SUMMARY' AS text UNION ALL SELECT 1, 'steps = ' || a FROM s UNION ALL SELECT 2, 'total = ' || b FROM s""")
def summary_report(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("steps"), F.sum("s_suppkey").alias("total")).first()
    return spark.createDataFrame(list(enumerate(metrics.report(r.asDict()).split("\n"))), "line int, text string")


# --- messages as a stream -----------------------------------------------------------------------------

MESSAGES = "SELECT CAST(user_id % 8 AS INT) AS gid, CASE event_id % 3 WHEN 0 THEN 'INIT' WHEN 1 THEN 'TRACE' ELSE 'FINISH' END AS kind, event_id AS particle_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS BIGINT) AS steps FROM events"


@query(f"SELECT gid, CAST(count_if(kind = 'INIT') AS BIGINT) AS inits, CAST(count_if(kind = 'FINISH') AS BIGINT) AS finishes, CAST(sum(steps) AS BIGINT) AS steps FROM ({MESSAGES}) GROUP BY 1")
def message_totals(spark, sf_dir):
    """Messages as a stream, some files at a time, with a state for each block; the last totals of each."""
    base = new_path(spark, "messages")
    k = F.col("event_id")
    m = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).cast("int").alias("gid"), F.when(k % 3 == 0, "INIT").when(k % 3 == 1, "TRACE").otherwise("FINISH").alias("kind"), k.alias("particle_id"), F.when(k % 3 == 0, 0).otherwise(k % 5).cast("long").alias("steps")
    )
    m.repartition(6).write.parquet(f"{base}/in")
    totals = stream.block_totals(stream.message_stream(spark, f"{base}/in", per_trigger=2))
    stream.run_to_folder(totals, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("gid").agg(F.max("inits").alias("inits"), F.max("finishes").alias("finishes"), F.max("steps").alias("steps"))
