import math

import pytest
from pyspark.sql import functions as F

from gridtrace.plans import config
from gridtrace.plans import grid as G


@pytest.mark.parametrize(
    "procs,divs,g512,g1024",
    [(2, (2, 1, 1), (1, 0, 0), (43, 0, 0)), (4, (2, 2, 1), (20, 20, 0), (82, 82, 0)), (8, (2, 2, 2), (50, 50, 50), (96, 96, 96)), (16, (4, 2, 2), (92, 62, 62), (150, 101, 101)), (32, (4, 4, 2), (105, 105, 71), (156, 156, 105))],
)
def test_known_divisions_and_elastic_ghosts(procs, divs, g512, g1024):
    size = (512, 512, 512)
    assert G.divisions(procs, 3) == divs
    assert G.elastic_ghosts(size, procs, procs, 512, 3) == g512
    assert G.elastic_ghosts(size, procs, procs, 1024, 3) == g1024
    strict = G.elastic_ghosts(size, procs, procs, 1024, 3, strict_limit=True)
    padded = [min(s // n + 2 * g, s) for s, n, g in zip(size, divs, strict)]
    assert math.prod(padded) * 12 <= 1024 * 2**20


def test_ghost_edge_cases():
    assert G.elastic_ghosts((64, 64), 1, 1, 64) == (0, 0)
    assert G.elastic_ghosts((64, 64), 4, 4, -1) == (10000, 10000)
    assert G.elastic_ghosts((8, 8, 8, 4), 2, 2, 1, 3, space_only=True) == (2, 0, 0)  # 4 + 2 * 2 is the whole of 8


@pytest.mark.parametrize("n", range(1, 33))
def test_unit_intervals(n):
    g = G.Grid.of((n,), n, 0)
    assert [g.core(i) for i in range(n)] == [((i,), (i,)) for i in range(n)]


def test_nine_blocks_of_a_continuous_cube():
    divs = G.divisions(9, 3)
    assert divs == (3, 3, 1)
    assert [round(G.core_1d(0, d, 0, 100, continuous=True)[1], 2) for d in divs] == [33.33, 33.33, 100.0]


def test_divisions_that_cannot_be():
    with pytest.raises(ValueError):
        G.divisions(7, 2, (2, 0))
    with pytest.raises(ValueError):
        G.Grid.of((2, 2), 16, 0)
    assert G.divisions(6, 2) == (3, 2) and G.divisions(6, 2, smallest_first=True) == (2, 3)
    assert G.divisions_longest(8, (100, 10, 10)) == (8, 1, 1)


@pytest.mark.parametrize("size,n", [((50, 11), 8), ((17, 9, 5), 6), ((7,), 3), ((6, 5, 4, 3), 4)])
def test_blocks_tile_and_owners_agree(spark, size, n):
    g = G.Grid.of(size, n, 1)
    boxes = [g.core(i) for i in range(n)]
    assert G.covers_domain(boxes, size)
    rows = {r["gid"]: r for r in g.blocks(spark).collect()}
    for i in range(n):
        lo, hi = g.core(i)
        glo, ghi = g.ghosted(i)
        for k, a in enumerate(G.AXES[: g.dims]):
            assert (rows[i][f"lb_{a}"], rows[i][f"ub_{a}"], rows[i][f"glb_{a}"], rows[i][f"gub_{a}"]) == (lo[k], hi[k], glo[k], ghi[k])
        assert G.coords_to_gid(G.gid_to_coords(i, g.divs), g.divs) == i
    from gridtrace.sources.fields import vertices

    axes = [F.col(a) for a in G.AXES[: g.dims]]
    for r in vertices(spark, size).withColumn("own", g.owner(axes)).withColumn("all", g.owners(axes)).collect():
        p = tuple(r[a] for a in G.AXES[: g.dims])
        inside = lambda b: all(x <= v <= y for v, x, y in zip(p, *b))
        assert inside(boxes[r["own"]])
        assert sorted(r["all"]) == [i for i in range(n) if inside(g.ghosted(i))]


def test_assigners(spark):
    df = spark.range(11).select("id", G.contiguous(F.col("id"), 11, 4).alias("c"), G.round_robin(F.col("id"), 4).alias("r")).collect()
    assert [r["c"] for r in df] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3] and [r["r"] for r in df] == [i % 4 for i in range(11)]


def test_centred_box_stays_inside():
    assert G.centred_ghost_box((0, 4), (3, 7), (6, 8), (8, 8)) == ((0, 0), (5, 7))


XML = """<config ghost_size="16" num_blocks="2" nb_per_proc="1" elastic_ghost="1" block_mem_limit="512" kd_tree="0"></config>
<dataset name="box"><run run_id="0" directory="{d}" pattern="*.nc"/><dimension name="x" size="8"/><dimension name="y" size="4"/><variable name="U" data_type="FLOAT32"/></dataset>"""


def test_xml(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.parse_xml(XML.format(d=tmp_path))
    (tmp_path / "a.nc").write_bytes(b"")
    c, d = config.parse_xml(XML.format(d=tmp_path))
    assert c.elastic_ghost and not c.kd_tree and c.ghost_size == 16 and c.epoch_size == 250 and c.blocks(8) == 8 and c.constrained
    assert d.size == (8, 4) and d.runs[0].filenames == [str(tmp_path / "a.nc")] and d.variables[0].name == "U"
    d.check(c)
    with pytest.raises(ValueError):
        d.check(config.TraceConfig(space_only=True))
