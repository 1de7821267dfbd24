"""Queries that trace every kind of step kernel, and seed the known set-ups, with recursive SQL that gives the same rows.

Fields are linear along each axis, so that interpolation is exact and the SQL can say a field's value
at any point; interpolation of fields that are not has queries of its own.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from gridtrace.catalog import QUERIES, SQL, order_points, query, table
from gridtrace.functions.interp import lerp_join
from gridtrace.functions.kernels import COLUMNS, EARTH, HOUR, HURRICANE_METRES, LEAST_SHRINK, MONTH, OMEGA, OMEGA_SCALE, DEGREE
from gridtrace.operators import seeds
from gridtrace.operators import trace as tr
from gridtrace.plans.grid import AXES, Grid
from gridtrace.sources import fields

# --- paths by kernel -----------------------------------------------------------------------------------

STEPS = 12
LIT = lambda v: f"{float(v):e}"  # noqa: E731  a double in either dialect


class Kernel:
    """A kernel's field, seeds and step size, and how its step is said in SQL."""

    def __init__(self, name: str, size: tuple[int, ...], h: float, field: dict[str, str], seed: list[str], wrap: bool = False):
        self.name, self.size, self.h, self.field, self.seed, self.wrap = name, size, h, field, seed, wrap
        self.axes = AXES[: len(size)]

    def value(self, var: str, suffix: str = "") -> str:
        """A variable at the point whose columns have the suffix."""
        return "(" + self.field[var].format(**{a: f"{a}{suffix}" for a in AXES}) + ")"

    def inside(self, suffix: str = "") -> str:
        return " AND ".join(f"{a}{suffix} >= 0 AND {a}{suffix} < {s - 1}" for a, s in zip(self.axes, self.size, strict=True))

    def sql(self) -> str:
        levels = [([], f"n < {STEPS} AND {self.inside()}"), *self.levels()]
        inner = "p"
        for columns, where in levels:
            inner = f"(SELECT *{''.join(f', {e} AS {n}' for n, e in columns)} FROM {inner}{f' WHERE {where}' if where else ''})"
        new = ", ".join(f"{a}_new" for a in self.axes)
        first = ", ".join(f"CAST({s} AS DOUBLE)" for s in self.seed)
        ends = ", ".join(f"round(arg_max({a}, n), 6) AS {a}" for a in self.axes)
        return (
            f"WITH RECURSIVE p(particle_id, n, {', '.join(self.axes)}) AS (SELECT CAST(s_suppkey AS BIGINT), 0, {first} FROM supplier UNION ALL SELECT particle_id, n + 1, {new} FROM {inner} q) "
            f"SELECT particle_id, CAST(max(n) AS INT) AS num_steps, {ends} FROM p GROUP BY particle_id"
        )

    def levels(self) -> list[tuple[list[tuple[str, str]], str]]:
        raise NotImplementedError

    def run(self, spark, sf_dir):
        d = len(self.size)
        #: Where x wraps, blocks are whole circles of latitude: stages of a step go over the seam.
        grid = Grid.of(self.size, 2, 3 if self.wrap else 2, given=(1, 2, *(1,) * (d - 2)) if self.wrap else None)
        vertices = fields.vertices(spark, self.size).selectExpr(*self.axes, *(f"CAST({e.format(**{a: a for a in AXES})} AS DOUBLE) AS {n}" for n, e in self.field.items()))
        bricks = fields.to_bricks(vertices, grid, list(self.field), "float64")
        plan = tr.Plan(grid, self.name, self.h, STEPS, round_steps=5, dtype="float64", wrap=self.wrap)
        start = seeds.from_table(table(spark, sf_dir, "supplier"), grid, "s_suppkey", self.seed, dtype="double")
        out = tr.trace(start, bricks, plan).particles
        return out.select("particle_id", F.col("num_steps").cast("int"), *(F.round(a, 6).alias(a) for a in AXES[:d]))


class Euler(Kernel):
    """x + factor * h * v / metres; time goes on by the step or by the distance over the speed."""

    def __init__(self, *args, factor=0.5, metres=(1.0, 1.0, 1.0), clock=None, **kw):
        super().__init__(*args, **kw)
        self.factor, self.metres, self.clock = factor, metres, clock

    def levels(self):
        space = list(zip("xyz", "uvw", self.metres, strict=True))
        new = [(f"{a}_new", f"{a} + {LIT(self.factor)} * ({LIT(self.h)} * {self.value(v)} / {LIT(m)})") for a, v, m in space]
        if self.clock is None:
            return [(new, "")]
        if self.clock == "step":
            return [(new, ""), ([("t_new", f"t + {LIT(self.h)}")], "")]
        far = "sqrt(" + " + ".join(f"pow(({a} - {a}_new) * {LIT(m)}, 2)" for a, _, m in space) + ")"
        speed = "sqrt(" + " + ".join(f"pow({self.value(v)}, 2)" for _, v, _ in space) + ")"
        return [(new, ""), ([("t_new", f"t + {far} / {speed} / {LIT(HOUR)}")], "")]


class Hurricane4(Kernel):
    """Four stages from the same start; each stage's time is the distance from there over the first speed."""

    def levels(self):
        space = list(zip("xyz", "uvw", HURRICANE_METRES, strict=True))
        out = [([("mag", "sqrt(" + " + ".join(f"pow({self.value(v)}, 2)" for _, v, _ in space) + ")")], "")]
        for k in range(4):
            before = "" if k == 0 else f"_{k}"
            to = f"_{k + 1}" if k < 3 else "_new"
            out.append(([(f"k{a}{k}", f"{LIT(self.h)} * {self.value(v, before)} / {LIT(m)}") for a, v, m in space], self.inside(before)))
            move = {a: f"5e-1 * k{a}{k}" if k < 3 else f"(k{a}0 + 2 * (k{a}1 + k{a}2) + k{a}3) / 6e0" for a, _, _ in space}
            out.append(([(f"{a}{to}", f"{a} + {move[a]}") for a, _, _ in space], ""))
            far = "sqrt(" + " + ".join(f"pow(({a} - {a}{to}) * {LIT(m)}, 2)" for a, _, m in space) + ")"
            out.append(([(f"t{to}", f"t + {far} / mag / {LIT(HOUR)}")], ""))
        return out


class Atmosphere(Kernel):
    def speed(self, suffix: str) -> dict[str, str]:
        """The grid velocity: the vertical part by omega and the layer's thickness, heights beyond the grid extrapolated."""
        zl = self.value("zl", suffix)
        above, below = (self.field["zl"].format(**{a: f"({a}{suffix} {s} 1)" if a == "z" else f"{a}{suffix}" for a in AXES}) for s in "-+")
        top, bottom = f"z{suffix} - 1 >= 0", f"z{suffix} + 1 < {self.size[2] - 1}"
        up = f"(CASE WHEN {top} THEN {above} ELSE {zl} + ({zl} - ({below})) END)"
        down = f"(CASE WHEN {bottom} THEN {below} ELSE {zl} - ({up} - {zl}) END)"
        thick = f"(({up} - {down}) * 5e-1 + ({zl} - {down}) * 5e-1)"
        return {"x": self.value("u", suffix), "y": self.value("v", suffix), "z": f"({self.value('om', suffix)} * {OMEGA} * {OMEGA_SCALE} * {thick} / {LIT(DEGREE)})"}

    @staticmethod
    def shrink(y: str) -> str:
        return f"(cos(radians(greatest(-90, least(90, {y} - 90)))) + {LIT(LEAST_SHRINK)})"

    def wrapped(self, x: str) -> str:
        return f"(CASE WHEN {x} > {COLUMNS - 1} THEN {x} - {COLUMNS - 1} WHEN {x} < 0 THEN {x} + {COLUMNS - 1} ELSE {x} END)" if self.wrap else x

    @staticmethod
    def far(x0: str, y0: str, x1: str, y1: str) -> str:
        lon = lambda x: f"greatest(-180, least(180, {x} * (36e1 / {COLUMNS - 1}) - 180))"
        lat = lambda y: f"radians(greatest(-90, least(90, {y} - 90)))"
        a = f"(pow(sin(({lat(y1)} - {lat(y0)}) / 2), 2) + cos({lat(y0)}) * cos({lat(y1)}) * pow(sin(radians({lon(x1)} - {lon(x0)}) / 2), 2))"
        return f"({LIT(EARTH)} * 2 * atan2(sqrt({a}), sqrt(1 - {a})))"


class Atmosphere1(Atmosphere):
    def levels(self):
        v, h = self.speed(""), LIT(self.h)
        out = [([(f"v{a}", v[a]) for a in "xyz"], "")]
        out.append(([("x_raw", f"x + 5e-1 * ({h} * vx)"), ("y_new", f"y + 5e-1 * ({h} * vy * {self.shrink('y')})"), ("z_new", f"z + 5e-1 * ({h} * vz)")], ""))
        out.append(([("x_new", self.wrapped("x_raw"))], ""))
        if len(self.size) == 4:
            out.append(([("t_new", f"t + {self.far('x', 'y', 'x_new', 'y_new')} / sqrt(vx * vx + vy * vy + vz * vz) / {LIT(MONTH)}")], ""))
        return out


class Atmosphere4(Atmosphere):
    def levels(self):
        h, out = LIT(self.h), []
        for k in range(4):
            before = "" if k == 0 else f"_{k}"
            to = f"_{k + 1}" if k < 3 else "_new"
            v = self.speed(before)
            out.append(([(f"v{a}{k}", v[a]) for a in "xyz"], self.inside(before)))
            if k == 0:
                out.append(([("mag", "sqrt(vx0 * vx0 + vy0 * vy0 + vz0 * vz0)")], ""))
            out.append(([(f"k{a}{k}", f"{h} * v{a}{k}" + (f" * {self.shrink('y' + before)}" if a == "y" and k < 3 else "")) for a in "xyz"], ""))
            move = {a: f"5e-1 * k{a}{k}" if k < 3 else f"(k{a}0 + 2 * (k{a}1 + k{a}2) + k{a}3) / 6e0" for a in "xyz"}
            out.append(([(f"x_raw{k}", f"x + {move['x']}"), (f"y{to}", f"y + {move['y']}"), (f"z{to}", f"z + {move['z']}")], ""))
            out.append(([(f"x{to}", self.wrapped(f"x_raw{k}"))], ""))
            out.append(([(f"t{to}", f"t + {self.far('x', 'y', 'x' + to, 'y' + to)} / mag / {LIT(MONTH)}")], ""))
        return out


def _seed(*spans: tuple[float, float]) -> list[str]:
    """A point for each supplier, spread over the spans."""
    steps = (7, 11, 13, 17)
    return [f"CAST(s_suppkey * {k} % 97 AS DOUBLE) / 97 * {LIT(b - a)} + {LIT(a)}" for k, (a, b) in zip(steps, spans, strict=False)]


_AIR = {"u": "6e-1 - 2e-2 * {y} + 1e-3 * {x} * {z}", "v": "3e-1 - 1e-3 * {x} * {z}", "w": "2e-1 - 5e-2 * {z} + 1e-3 * {x}"}
_AIR_T = {n: f"{e} + 2e-2 * {{t}}" for n, e in _AIR.items()}
_WIND = {n: f"6e0 * ({e})" for n, e in _AIR.items()}
_WIND_T = {n: f"6e0 * ({e})" for n, e in _AIR_T.items()}
_EARTH = {"u": "4e0 - 1e-1 * {y} + 2e-1 * {z}", "v": "8e-1 - 5e-2 * {z}", "om": "1e-3 - 2e-4 * {z}", "zl": "9e2 - 8e1 * {z} + 5e-1 * {z} * {y}"}
_EARTH_T = {n: f"{e} + {t} * {{t}}" for (n, e), t in zip(_EARTH.items(), ("1e-1", "2e-2", "1e-4", "3e0"), strict=True)}
_SMALL, _SMALL_T = (16, 12, 8), (16, 12, 8, 6)
_GLOBE, _GLOBE_T = (COLUMNS, 12, 6), (COLUMNS, 12, 6, 4)
_IN, _IN_T = ((1, 13), (1, 9), (1, 6)), ((1, 13), (1, 9), (1, 6), (0.2, 3))
_ON, _ON_T = ((3, 286), (2, 9), (0.5, 4.5)), ((3, 286), (2, 9), (0.5, 4.5), (0.2, 2))

KERNELS = [
    Euler("rk1_3d", _SMALL, 0.8, _AIR, _seed(*_IN)),
    Euler("rk1_4d", _SMALL_T, 0.3, _AIR_T, _seed(*_IN_T), factor=1.0, clock="step"),
    Euler("hurricane_rk1_3d", _SMALL, 450.0, _WIND, _seed(*_IN), metres=HURRICANE_METRES),
    Euler("hurricane_rk1_4d", _SMALL_T, 450.0, _WIND_T, _seed(*_IN_T), metres=HURRICANE_METRES, clock="distance"),
    Hurricane4("hurricane_rk4_4d", _SMALL_T, 450.0, _WIND_T, _seed(*_IN_T)),
    Atmosphere1("atmosphere_rk1_3d", _GLOBE, 0.3, _EARTH, _seed(*_ON), wrap=True),
    Atmosphere1("atmosphere_rk1_4d", _GLOBE_T, 0.3, _EARTH_T, _seed(*_ON_T), wrap=True),
    Atmosphere4("atmosphere_rk4_4d", _GLOBE_T, 0.3, _EARTH_T, _seed(*_ON_T), wrap=True),
]
for _k in KERNELS:
    QUERIES[f"kernel_{_k.name}"], SQL[f"kernel_{_k.name}"] = _k.run, _k.sql()

# --- interpolation in three and four dimensions ------------------------------------------------------


def _lerp(d: int, size: tuple[int, ...]):
    axes, primes = AXES[:d], (7919, 104729, 1299709, 15485863)
    value = lambda salt, names: f"CAST(({' + '.join(f'{n} * {p}' for n, p in zip(names, primes, strict=False))} + {salt}) % 1000 AS DOUBLE) / 1000"
    coords = [f"CAST(o_orderkey * {k} % 1000 AS DOUBLE) / 1000 * {LIT(s - 1.001)}" for k, s in zip((1, 7, 11, 13), size, strict=False)]
    corners = ", ".join(f"({', '.join(map(str, c))})" for c in itertools.product((0, 1), repeat=d))
    weight = " * ".join(f"CASE WHEN d{a} = 1 THEN {a} - floor({a}) ELSE 1 - ({a} - floor({a})) END" for a in axes)
    at = [f"(CAST(floor({a}) AS BIGINT) + d{a})" for a in axes]
    sql = (
        f"WITH q AS (SELECT o_orderkey AS k, {', '.join(f'{c} AS {a}' for c, a in zip(coords, axes, strict=True))} FROM orders), c({', '.join(f'd{a}' for a in axes)}) AS (VALUES {corners}) "
        f"SELECT k, round(sum({weight} * ({value(0, at)})), 6) AS u, round(sum({weight} * ({value(500, at)})), 6) AS v FROM q, c GROUP BY k"
    )

    def run(spark, sf_dir):
        points = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", *(f"{c} AS {a}" for c, a in zip(coords, axes, strict=True)))
        field = fields.vertices(spark, size).selectExpr(*axes, f"{value(0, axes)} AS u", f"{value(500, axes)} AS v")
        return lerp_join(points, field, list(axes), ["u", "v"], "k").select("k", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))

    return run, sql


QUERIES["lerp_trilinear"], SQL["lerp_trilinear"] = _lerp(3, (11, 9, 7))
QUERIES["lerp_quadrilinear"], SQL["lerp_quadrilinear"] = _lerp(4, (8, 7, 6, 5))

# --- seeds of the known set-ups -----------------------------------------------------------------------


def _axis(name: str, n: int, size: int) -> str:
    """Lattice values added up in single precision."""
    gap = f"CAST(CAST(CAST(1 AS REAL) / CAST({n - 1} AS REAL) AS REAL) * CAST({size - 1} AS REAL) AS REAL)"
    return f"{name}(v) AS (SELECT CAST(0 AS REAL) UNION ALL SELECT CAST(v + {gap} AS REAL) FROM {name} WHERE CAST(v + {gap} AS REAL) <= {size - 1})"


def _setup(name: str, size: tuple[int, ...], n_blocks: int):
    s, grid = seeds.SETUPS[name], Grid.of(size, n_blocks, 1)
    axes = AXES[: len(size)]
    if s.box:
        made = [f"{a}s(v) AS (SELECT CAST(i AS REAL) FROM generate_series({lo}, {hi}) g(i))" for a, (lo, hi) in zip(axes, s.box, strict=True)]
    else:
        made = [_axis(f"{a}s", n, k) for a, n, k in zip(axes, s.lattice, size, strict=True)]
    gid, stride = [], 1
    for a, n, k in zip(axes, grid.divs, size, strict=True):
        gid.append(f"least({n - 1}, CAST(trunc({a}s.v) AS INT) // {k // n}) * {stride}")
        stride *= n
    low = " AND ".join(f"{a}s.v <> 0" for a in axes) if s.drop_zero else "true"
    ends = ", ".join(f"CAST(min({a}s.v) AS DOUBLE) AS lo_{a}, CAST(max({a}s.v) AS DOUBLE) AS hi_{a}" for a in axes)
    sql = f"WITH RECURSIVE {', '.join(made)} SELECT CAST({' + '.join(gid)} AS INT) AS home_gid, count(*) AS n, {ends} FROM {', '.join(f'{a}s' for a in axes)} WHERE {low} GROUP BY 1"

    def run(spark, sf_dir):
        got = seeds.of_setup(spark, name, grid).groupBy("home_gid")
        return got.agg(F.count("*").alias("n"), *(f(a).cast("double").alias(f"{w}_{a}") for a in axes for w, f in (("lo", F.min), ("hi", F.max))))

    return run, sql


for _name, _size, _n in (
    ("synthetic_2d", (64, 64), 4), ("turbulence_3d", (512, 512, 512), 8), ("hurricane_3d", (500, 500, 100), 8),
    ("hurricane_4d", (500, 500, 100, 48), 8), ("atmosphere_4d", (288, 181, 72, 24), 8), ("atmosphere_4d_full", (288, 181, 72, 24), 8),
):
    QUERIES[f"setup_{_name}"], SQL[f"setup_{_name}"] = _setup(_name, _size, _n)


@query(f"""WITH RECURSIVE {_axis('a', 512, 512)} SELECT CAST(count(*) * count(*) * count(*) AS BIGINT) AS n, CAST(max(v) AS DOUBLE) AS last FROM a""")
def setup_turbulence_3d_dense(spark, sf_dir):
    """The dense lattice: how many seeds its axes make, and its last value. All seeds are made and counted."""
    made = seeds.of_setup(spark, "turbulence_3d_dense", Grid.of((512, 512, 512), 8, 1))
    return made.agg(F.count("*").alias("n"), F.max("x").cast("double").alias("last"))


@query("SELECT o_orderkey AS particle_id, round(o_totalprice / 10500e0, 6) AS x, round(CAST(o_orderkey % 1000 AS DOUBLE) / 100, 6) AS y, CAST(least(3, CAST(trunc(o_totalprice / 10500e0) AS INT) // 12) + 4 * least(1, CAST(trunc(CAST(o_orderkey % 1000 AS DOUBLE) / 100) AS INT) // 5) AS INT) AS home_gid FROM orders")
def seed_from_table(spark, sf_dir):
    """Seeds of a table, with their owners."""
    made = seeds.from_table(order_points(spark, sf_dir), Grid.of((50, 11), 8, 2), "k", ["x", "y"], dtype="double")
    return made.select("particle_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "home_gid")
