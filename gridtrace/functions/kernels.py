"""Step kernels over arrays of particles, with masks instead of loops.

State is of the field's type, float32 unless asked otherwise; what the model computes in double is
computed in double and rounded on store. A step gives a status each: 0 done, 1 out of bounds, 2 no
value, 3 critical point. Where a later stage of a step fails, the particle stays where it began.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from gridtrace.functions.interp import inside, lerp

#: Status codes; metres a grid cell; seconds an hour and a month; grid columns; the earth's radius in metres.
SUCC, OUT_OF_BOUND, NO_VALUE, CRITICAL_POINT = 0, 1, 2, 3
HURRICANE_METRES = (1940.0 / 500 * 1000, 2004.0 / 500 * 1000, 19.8 / 100 * 1000)
HOUR, MONTH = 3600.0, 2629744.0
COLUMNS, EARTH = 288, 6371000.0
#: Pascals a hectopascal times ten, scale factor and metres a degree of the vertical speed; least shrinking by latitude; least speed.
OMEGA, OMEGA_SCALE, DEGREE = 1000, 44, 111000
LEAST_SHRINK, LEAST_SPEED = 0.01, 1e-5


#: Of a step only: a later stage left the domain, not the brick alone, so no other brick can do the step.
LEFT_DOMAIN = 4


@dataclass
class Brick:
    """Variables of one block over its loaded box, and the ghosted box that particles may use."""

    data: np.ndarray
    start: np.ndarray
    ghost_start: np.ndarray
    ghost_size: np.ndarray
    domain: np.ndarray | None = None

    @staticmethod
    def whole(data: np.ndarray) -> Brick:
        size = np.array(data.shape[:0:-1])
        zero = np.zeros(len(size), dtype=np.int64)
        return Brick(data, zero, zero, size)

    def sample(self, x: np.ndarray, variables: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
        data = self.data if variables is None else self.data[variables]
        return lerp(x, data, self.start, self.ghost_start, self.ghost_size)

    def inside(self, x: np.ndarray) -> np.ndarray:
        return inside(x, self.ghost_start, self.ghost_size)


def _stage(brick: Brick, at: np.ndarray, ok: np.ndarray, status: np.ndarray) -> None:
    """Mark steps whose stage could not be sampled."""
    failed = (status == SUCC) & ~ok
    status[failed] = OUT_OF_BOUND
    if brick.domain is not None:
        status[failed & ~((at >= 0) & (at < brick.domain - 1)).all(axis=1)] = LEFT_DOMAIN


def _bad(v: np.ndarray) -> np.ndarray:
    return ~np.isfinite(v).all(axis=1)


def euler(dims: int, factor: float = 0.5, critical: bool = True, scale: tuple[float, ...] = (), clock: str | None = None):
    """X += factor * h * v. ``scale``: metres a cell. ``clock``: how the last coordinate, time, goes on."""

    def step(brick: Brick, x: np.ndarray, h: float, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
        status = np.full(len(x), SUCC, dtype=np.int8)
        n = dims - 1 if clock else dims
        v, ok = brick.sample(x, slice(0, n))
        status[~ok] = OUT_OF_BOUND
        status[ok & _bad(v)] = NO_VALUE
        squares = (v.astype(np.float64) ** 2).sum(axis=1)
        if critical:
            status[ok & (squares == 0)] = CRITICAL_POINT
        metres = np.array(scale[:n] or (1.0,) * n, dtype=x.dtype)
        k = (x.dtype.type(h) * v) / metres
        new = x.copy()
        new[:, :n] = (x[:, :n].astype(np.float64) + factor * k.astype(np.float64)).astype(x.dtype)
        if clock == "step":
            new[:, n] = x[:, n] + x.dtype.type(h)
        elif clock == "distance":
            far = np.sqrt((((x[:, :n] - new[:, :n]).astype(np.float64) * metres) ** 2).sum(axis=1))
            with np.errstate(all="ignore"):
                dt = far / np.sqrt(squares) / np.copysign(HOUR, h)
            status[(status == SUCC) & ~np.isfinite(dt)] = NO_VALUE
            new[:, n] = (x[:, n].astype(np.float64) + dt).astype(x.dtype)
        done = status == SUCC
        return np.where(done[:, None], new, x), status

    return step


def hurricane_rk4(brick: Brick, x: np.ndarray, h: float, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Four stages; slow points are moved on in time by 0.01 first; time goes by distance and first-stage speed."""
    metres = np.array(HURRICANE_METRES, dtype=x.dtype)
    p0, status, v, mag = _moved_on(lambda y: brick.sample(y, slice(0, 3)), x, 0.01)
    k, cur = [], p0
    for stage in range(4):
        if stage:
            v, ok = brick.sample(cur, slice(0, 3))
            _stage(brick, cur, ok, status)
        k.append((x.dtype.type(h) * v / metres).astype(np.float64))
        move = 0.5 * k[-1] if stage < 3 else (k[0] + 2.0 * (k[1] + k[2]) + k[3]) / 6.0
        nxt = p0.copy()
        nxt[:, :3] = (p0[:, :3].astype(np.float64) + move).astype(x.dtype)
        far = np.sqrt((((p0[:, :3] - nxt[:, :3]).astype(np.float64) * metres) ** 2).sum(axis=1))
        with np.errstate(all="ignore"):
            nxt[:, 3] = (p0[:, 3].astype(np.float64) + far / mag / np.copysign(HOUR, h)).astype(x.dtype)
        status[(status == SUCC) & _bad(nxt)] = NO_VALUE
        cur = np.where((status == SUCC)[:, None], nxt, p0)
    return np.where((status == SUCC)[:, None], cur, p0), status


def _moved_on(sample: Callable, x: np.ndarray, by: float, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points with those of almost no speed moved on in time, their status, velocity and speed."""
    p, status = x.copy(), np.full(len(x), SUCC, dtype=np.int8)
    v, ok = sample(p)
    for k in range(most + 1):
        mag = np.sqrt((v[:, :3].astype(np.float64) ** 2).sum(axis=1))
        slow = np.flatnonzero(ok & (mag < LEAST_SPEED))
        if not len(slow):
            break
        if k == most:
            raise RuntimeError(f"{len(slow)} points have almost no speed after {most} moves in time")
        p[slow, 3] = (p[slow, 3].astype(np.float64) + by).astype(x.dtype)
        v[slow], ok[slow] = sample(p[slow])
    status[~ok] = OUT_OF_BOUND
    status[ok & ~np.isfinite(mag)] = NO_VALUE
    return p, status, v, mag


# --- an atmosphere on a longitude-latitude grid of 288 columns ------------------------------------


def x_to_lon(x):
    return np.clip(np.asarray(x, dtype=np.float64) * (360.0 / (COLUMNS - 1)) - 180.0, -180.0, 180.0)


def y_to_lat(y):
    return np.clip(np.asarray(y, dtype=np.float64) - 90.0, -90.0, 90.0)


def wrap_x(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[x > COLUMNS - 1] -= COLUMNS - 1
    out[x < 0] += COLUMNS - 1
    return out


def haversine(x0, y0, x1, y1):
    """Metres between two grid points."""
    a0, a1 = np.radians(y_to_lat(y0)), np.radians(y_to_lat(y1))
    dlon = np.radians(x_to_lon(x1) - x_to_lon(x0))
    a = np.sin((a1 - a0) / 2) ** 2 + np.cos(a0) * np.cos(a1) * np.sin(dlon / 2) ** 2
    return EARTH * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def atmosphere_velocity(brick: Brick, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid velocity: the vertical part from omega and the layer's thickness.

    Where the layer above or below can't be sampled its height is extrapolated from the other.
    """
    vals, ok = brick.sample(x)
    up, down = x.copy(), x.copy()
    up[:, 2] -= 1
    down[:, 2] += 1
    above, ok_up = brick.sample(up, slice(3, 4))
    below, ok_down = brick.sample(down, slice(3, 4))
    above, below, zl = above[:, 0], below[:, 0], vals[:, 3]
    above = np.where(ok_up, above, zl + (zl - below))
    below = np.where(ok_down, below, zl - (above - zl))
    half = vals.dtype.type(0.5)
    thick = (above - below) * half + (zl - below) * half
    v = np.stack([vals[:, 0], vals[:, 1], vals[:, 2] * vals.dtype.type(OMEGA) * OMEGA_SCALE * thick / vals.dtype.type(DEGREE)], axis=1)
    return v.astype(x.dtype), ok


def _shrink(x: np.ndarray) -> np.ndarray:
    return np.cos(np.radians(y_to_lat(x[:, 1]))) + LEAST_SHRINK


def atmosphere_rk1(dims: int):
    def step(brick: Brick, x: np.ndarray, h: float, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
        status = np.full(len(x), SUCC, dtype=np.int8)
        v, ok = atmosphere_velocity(brick, x)
        status[~ok] = OUT_OF_BOUND
        squares = (v.astype(np.float64) ** 2).sum(axis=1)
        if dims == 3:
            status[ok & (squares == 0)] = CRITICAL_POINT
        k = x.dtype.type(h) * v
        k[:, 1] *= _shrink(x).astype(x.dtype)
        new = x.copy()
        new[:, :3] = (x[:, :3].astype(np.float64) + 0.5 * k.astype(np.float64)).astype(x.dtype)
        if wrap:
            new[:, 0] = wrap_x(new[:, 0])
        if dims == 4:
            far = haversine(x[:, 0], x[:, 1], new[:, 0], new[:, 1])
            with np.errstate(all="ignore"):
                dt = np.where(np.isfinite(far), far / np.sqrt(squares) / np.copysign(MONTH, h), 0.1)
            status[(status == SUCC) & ~np.isfinite(dt)] = NO_VALUE
            new[:, 3] = (x[:, 3].astype(np.float64) + dt).astype(x.dtype)
        done = status == SUCC
        return np.where(done[:, None], new, x), status

    return step


def atmosphere_rk4(brick: Brick, x: np.ndarray, h: float, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    p0, status, v, mag = _moved_on(lambda y: atmosphere_velocity(brick, y), x, 1e-3)
    k, cur = [], p0
    for stage in range(4):
        if stage:
            v, ok = atmosphere_velocity(brick, cur)
            _stage(brick, cur, ok, status)
        step = x.dtype.type(h) * v
        if stage < 3:
            step[:, 1] *= _shrink(cur).astype(x.dtype)
        k.append(step.astype(np.float64))
        move = 0.5 * k[-1] if stage < 3 else (k[0] + 2.0 * (k[1] + k[2]) + k[3]) / 6.0
        nxt = p0.copy()
        nxt[:, :3] = (p0[:, :3].astype(np.float64) + move).astype(x.dtype)
        status[(status == SUCC) & _bad(nxt[:, :3])] = NO_VALUE
        if wrap:
            nxt[:, 0] = wrap_x(nxt[:, 0])
        far = haversine(p0[:, 0], p0[:, 1], nxt[:, 0], nxt[:, 1])
        with np.errstate(all="ignore"):
            dt = np.where(np.isfinite(far), far / mag / np.copysign(MONTH, h), 0.1)
        nxt[:, 3] = (p0[:, 3].astype(np.float64) + dt).astype(x.dtype)
        cur = np.where((status == SUCC)[:, None], nxt, p0)
    return np.where((status == SUCC)[:, None], cur, p0), status


KERNELS: dict[str, Callable] = {
    "rk1_2d": euler(2),
    "rk1_3d": euler(3),
    "rk1_4d": euler(4, factor=1.0, critical=False, clock="step"),
    "hurricane_rk1_3d": euler(3, scale=HURRICANE_METRES),
    "hurricane_rk1_4d": euler(4, critical=False, scale=HURRICANE_METRES, clock="distance"),
    "hurricane_rk4_4d": hurricane_rk4,
    "atmosphere_rk1_3d": atmosphere_rk1(3),
    "atmosphere_rk1_4d": atmosphere_rk1(4),
    "atmosphere_rk4_4d": atmosphere_rk4,
}


def advance(kernel: Callable, brick: Brick, x: np.ndarray, steps: np.ndarray, h: float, budget: int, most: int, domain: np.ndarray, wrap: bool = False, marks: tuple[int, ...] = ()):
    """Trace particles within one brick until each stops, leaves it or has used its budget.

    Returns positions, steps, finished flags, statuses, work done, and at each mark (budget left) the
    positions then. Leaving the ghosted box is no work; a critical point is work but no step.
    """
    n, brick.domain = len(x), domain
    x, steps = x.copy(), steps.copy()
    status, finished, work = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    left = np.full(n, budget)
    seen = {m: (x.copy(), np.zeros(n, dtype=bool)) for m in marks}
    live = np.flatnonzero((steps < most) & (left > 0))
    while len(live):
        new, st = kernel(brick, x[live], h, wrap)
        finished[live] |= st == LEFT_DOMAIN
        st = np.where(st == LEFT_DOMAIN, OUT_OF_BOUND, st)
        status[live] = st
        work[live] += st != OUT_OF_BOUND
        finished[live] |= (st == CRITICAL_POINT) | (st == NO_VALUE)
        x[live] = new
        go = live[st == SUCC]
        steps[go] += 1
        left[go] -= 1
        for m, (at, hit) in seen.items():
            now = go[left[go] == m]
            at[now], hit[now] = x[now], True
        live = go[(left[go] > 0) & (steps[go] < most)]
    inside_domain = ((x >= 0) & (x < domain - 1)).all(axis=1)
    finished |= ~inside_domain | (steps >= most)
    return x, steps, finished, status, work, left, seen
