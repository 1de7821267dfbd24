import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtrace.functions import geometry as G
from gridtrace.plans.config import Dataset, Dimension, Run, infer_time
from gridtrace.plans.grid import Grid
from gridtrace.sources import block_store, fields, netcdf, raw, read_plan
from gridtrace.streaming import events


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("record", [None, "t"])
def test_netcdf_boxes(tmp_path, version, record):
    rng = np.random.default_rng(0)
    a, b = rng.random((4, 3, 5, 6)).astype("f4"), rng.integers(0, 100, (4, 3, 5, 6)).astype("i2")
    p = str(tmp_path / "f.nc")
    dims = [("t", 4), ("z", 3), ("y", 5), ("x", 6)]
    netcdf.write(p, dims, {"U": (list("tzyx"), a), "K": (list("tzyx"), b), "m": (["x"], np.arange(6.0))}, version, record)
    with open(p, "rb") as f:

        class Sized:
            seek, read = f.seek, f.read

        h = netcdf.read_header(Sized)
        assert h.shape("U") == a.shape and h.dim_names("U") == list("tzyx")
        for start, size in (((0, 0, 0, 0), (4, 3, 5, 6)), ((1, 1, 2, 3), (2, 2, 3, 2)), ((3, 0, 0, 0), (1, 3, 5, 6)), ((0, 2, 0, 5), (4, 1, 5, 1))):
            cut = tuple(slice(s, s + n) for s, n in zip(start, size))
            assert (netcdf.read_box(Sized, h, "U", start, size) == a[cut]).all() and (netcdf.read_box(Sized, h, "K", start, size) == b[cut]).all()
        assert (netcdf.read_box(Sized, h, "m", (2,), (3,)) == [2, 3, 4]).all()
        with pytest.raises(ValueError):
            netcdf.read_box(Sized, h, "m", (4,), (3,))


def test_netcdf_source_over_files(spark, tmp_path):
    full = np.arange(5 * 4 * 3, dtype="f4").reshape(5, 4, 3)
    paths = []
    for k, (a, b) in enumerate(((0, 2), (2, 5))):
        paths.append(str(tmp_path / f"{k}.nc"))
        netcdf.write(paths[-1], [("t", b - a), ("y", 4), ("x", 3)], {"U": (list("tyx"), full[a:b]), "V": (list("tyx"), -full[a:b])})
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("slab_bytes", 100).option("variables", "U,V").load(",".join(paths))
    assert df.columns == ["x", "y", "t", "U", "V"]
    got = {(r.t, r.y, r.x): (r.U, r.V) for r in df.collect()}
    assert got == {(t, y, x): (full[t, y, x], -full[t, y, x]) for t in range(5) for y in range(4) for x in range(3)}
    some = df.where("t >= 1 AND t < 4 AND x = 2 AND y IN (0, 3)")
    assert sorted(r.U for r in some.collect()) == sorted(full[1:4, [0, 3], 2].reshape(-1).tolist())
    assert some.rdd.getNumPartitions() <= 3
    assert (netcdf.read_many(paths, "U", (1, 1, 0), (3, 2, 3)) == full[1:4, 1:3]).all()
    with pytest.raises(ValueError):
        netcdf.read_many(paths, "U", (4, 0, 0), (3, 4, 3))
    data = Dataset("d", [Run(0, "", "", paths)], dimensions=[Dimension(n, 0) for n in "xyzt"])

    def steps(p):
        with open(p, "rb") as f:
            return netcdf.read_header(f).shape("U")[0]

    assert infer_time(data, steps).size[3] == 5 and data.timesteps_per_file == [2, 3]


def test_raw_bricks(spark, tmp_path):
    p = str(tmp_path / "m.bov")
    raw.create(p, (4, 3), "<i4")
    raw.write_box(p, (4, 3), (0, 0), np.arange(1, 7, dtype="<i4").reshape(2, 3))
    raw.write_box(p, (4, 3), (2, 0), np.arange(7, 13, dtype="<i4").reshape(2, 3))
    assert (np.fromfile(p, "<i4") == np.arange(1, 13)).all()
    f = np.arange(256, dtype="f4").reshape(16, 16)
    q = str(tmp_path / "f.bov")
    raw.create(q, (16, 16), header=b"head")
    raw.write_box(q, (16, 16), (0, 0), f, header=4)
    assert (raw.read_box(q, (16, 16), (4, 4), (4, 4), header=4) == f[4:8, 4:8]).all()
    raw.write_box(q, (16, 16), (8, 8), np.full((4, 4), -1, "f4"), core=((1, 1), (2, 2)), header=4)
    assert (raw.read_box(q, (16, 16), (8, 8), (2, 2), header=4) == -1).all()
    assert (raw.read_box(q, (8, 16), (1, 2), (2, 3), chunk=2, header=4)[..., 0] == f.reshape(8, 16, 2)[1:3, 2:5, 0]).all()
    raw.register(spark)
    df = spark.read.format("brick").option("shape", "4,3").option("dtype", "<i4").option("slab_bytes", 13).load(p)
    assert {(r.x, r.y): r.value for r in df.collect()} == {(x, y): 1 + y * 3 + x for x in range(3) for y in range(4)}


def test_npy(spark, tmp_path):
    p = str(tmp_path / "a.npy")
    a = np.arange(256, dtype="f4").reshape(16, 16)
    raw.write_npy(p, (16, 16), "<f4", [((0, 0), a[:8]), ((8, 0), a[8:])])
    assert (np.load(p) == a).all() and raw.npy_header(p)[2] % 16 == 0
    assert (raw.read_npy_box(p, (4, 4), (4, 4)) == a[4:8, 4:8]).all()
    c = str(tmp_path / "c.npy")
    np.save(c, (a + 1j).astype("c8"))
    assert raw.read_npy_box(c, (0, 0), (1, 2)).dtype == np.dtype("c8")
    np.save(c, np.asfortranarray(a))
    with pytest.raises(ValueError):
        raw.npy_header(c)
    raw.register(spark)
    df = spark.read.format("brick").load(p)
    assert df.count() == 256 and df.where("x = 3 AND y = 2").first()["value"] == 35


def test_converter(tmp_path):
    v = np.random.default_rng(0).random((8, 8, 8, 3)).astype(">f4")
    (tmp_path / "i.raw").write_bytes(v.tobytes())
    out = str(tmp_path / "o.nc")
    raw.convert(str(tmp_path / "i.raw"), out, (8, 8, 8), ["U", "V", "W"])
    with open(out, "rb") as f:
        h = netcdf.read_header(f)
        for k, n in enumerate("UVW"):
            assert (netcdf.read_box(f, h, n, (0, 0, 0), (8, 8, 8)) == v[..., k]).all()
    assert G.swap_bytes(b"\0\0\0\1", ">i4") == b"\1\0\0\0" and G.big_endian() in (True, False)


def test_written_bricks(spark, tmp_path):
    grid = Grid.of((6, 4), 4, 0)
    data = np.arange(24, dtype="f4").reshape(1, 4, 6)
    rows = [(g, [lo[1], lo[0]], [hi[1] - lo[1] + 1, hi[0] - lo[0] + 1], np.ascontiguousarray(data[0, lo[1] : hi[1] + 1, lo[0] : hi[0] + 1]).tobytes()) for g in range(4) for lo, hi in [grid.core(g)]]
    df = spark.createDataFrame([(g, a, s, bytearray(d)) for g, a, s, d in rows], "gid int, start array<int>, shape array<int>, data binary")
    p = str(tmp_path / "w.bov")
    raw.write_bricks(df, p, (4, 6))
    assert (np.fromfile(p, "<f4").reshape(4, 6) == data[0]).all()
    assert fields.bricks_from_array(spark, data, grid).count() == 4


@pytest.mark.parametrize("split", [False, True])
def test_block_store(spark, tmp_path, split):
    df = spark.range(60).select((F.col("id") % 6).cast("int").alias("gid"), F.col("id").alias("v"))
    block_store.write_blocks(df, str(tmp_path / "s"), {"step": 3}, split)
    got, foot, extra = block_store.read_blocks(spark, str(tmp_path / "s"), [1, 4], n_ranks=4)
    assert extra == {"step": 3} and got.count() == 20 and {r["rank"] for r in got.collect()} == {0, 1}
    assert [(r["gid"], r["count"], r["offset"]) for r in foot.collect()] == [(g, 10, 10 * g) for g in range(6)]
    block_store.dump(b"abc", str(tmp_path / "d"))
    assert block_store.load(str(tmp_path / "d")) == b"abc"


def test_read_plans_cover_requests(spark):
    req = [(1, "f", "u", [0, 0], [4, 4]), (2, "f", "u", [2, 3], [9, 8]), (3, "g", "u", [0, 0], [1, 1])]
    r = spark.createDataFrame(req, "id int, file string, var string, start array<int>, end array<int>")
    got = read_plan.exchange_plan(r, read_plan.io_blocks(r, 2, 6), 2).collect()
    for i, _, _, a, b in req:
        cells = [(x, y) for g in got if g["id"] == i for x in range(g["part_start"][0], g["part_end"][0]) for y in range(g["part_start"][1], g["part_end"][1])]
        assert sorted(cells) == [(x, y) for x in range(a[0], b[0]) for y in range(a[1], b[1])]
    assert read_plan.assign_readers(list("abcde"), 2)[-1][0] == 2
    parts = read_plan.split_box((0, 0), (2, 10), 6)
    assert len(parts) == 6


def test_point_keys_and_no_values(spark):
    df = spark.createDataFrame([(1, -2, 3)], "x int, y int, z int")
    k = df.select(G.point_key([F.col(c) for c in "xyz"]).alias("k"))
    assert tuple(k.select(*G.point_from_key(F.col("k"), 3)).first()) == (1, -2, 3)
    m = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "m double").select(G.no_value(F.col("m")).alias("n"), G.in_domain([F.col("m")], (8,)).alias("d"))
    assert [tuple(r) for r in m.collect()] == [(True, False), (True, False), (False, True)]


def test_messages_with_state(spark, tmp_path):
    rows = [(g, k, p, s) for g in range(3) for p in range(4) for k, s in (("INIT", 0), ("TRACE", 5), ("FINISH", 0))]
    spark.createDataFrame(rows, events.MESSAGES).repartition(2).write.parquet(str(tmp_path / "m"))
    stream = events.block_totals(events.message_stream(spark, str(tmp_path / "m"), 1))
    events.run_to_table(stream, "totals", str(tmp_path / "c"))
    t = spark.table("totals")
    last = {r["gid"]: (r["inits"], r["finishes"], r["steps"]) for r in t.groupBy("gid").agg(F.max("inits").alias("inits"), F.max("finishes").alias("finishes"), F.max("steps").alias("steps")).collect()}
    assert last == {g: (4, 4, 20) for g in range(3)} and events.all_done(t)
