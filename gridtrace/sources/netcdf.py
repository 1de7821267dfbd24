"""Classic NetCDF (CDF-1, CDF-2 and CDF-5): header parser, box reads, writer and Spark source.

A box read seeks to each contiguous run of the box, so only wanted bytes are read. The source plans a
partition for each slab along the slowest dimension, and skips slabs and clips boxes by pushed filters
on the coordinates.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Type codes of the format.
CODES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
SPARK = {
    "i1": T.ByteType(), "S1": T.StringType(), ">i2": T.ShortType(), ">i4": T.IntegerType(), ">f4": T.FloatType(), ">f8": T.DoubleType(),
    "u1": T.ShortType(), ">u2": T.IntegerType(), ">u4": T.LongType(), ">i8": T.LongType(), ">u8": T.DecimalType(20, 0),
}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12


@dataclass
class Var:
    name: str
    dims: list[int]
    dtype: str
    begin: int
    record: bool = False


@dataclass
class Header:
    dims: list[tuple[str, int]] = field(default_factory=list)
    variables: dict[str, Var] = field(default_factory=dict)
    records: int = 0
    record_size: int = 0

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.records if self.dims[d][1] == 0 else self.dims[d][1] for d in self.variables[name].dims)

    def dim_names(self, name: str) -> list[str]:
        return [self.dims[d][0] for d in self.variables[name].dims]


def _open(path: str):
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(p)


def _create(path: str):
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    system.create_dir(p.rpartition("/")[0], recursive=True)
    return system.open_output_stream(p)


def read_header(f) -> Header:
    f.seek(0)
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    version = magic[3]
    num = (lambda: struct.unpack(">q", f.read(8))[0]) if version == 5 else (lambda: struct.unpack(">i", f.read(4))[0])
    offset = (lambda: struct.unpack(">i", f.read(4))[0]) if version == 1 else (lambda: struct.unpack(">q", f.read(8))[0])
    tag = lambda: struct.unpack(">i", f.read(4))[0]

    def name() -> str:
        n = num()
        text = f.read(n).decode()
        f.read(-n % 4)
        return text

    def skip_attributes() -> None:
        if tag() not in (0, _ATTRIBUTE):
            raise ValueError("broken header")
        for _ in range(num()):
            name()
            code = tag()
            n = num() * np.dtype(CODES[code]).itemsize
            f.read(n + -n % 4)

    h = Header(records=num())
    tag()
    for _ in range(num()):
        h.dims.append((name(), num()))
    skip_attributes()
    tag()
    for _ in range(num()):
        v = name()
        dims = [num() for _ in range(num())]
        skip_attributes()
        dtype = CODES[tag()]
        size = num()
        record = bool(dims) and h.dims[dims[0]][1] == 0
        h.variables[v] = Var(v, dims, dtype, offset(), record)
        h.record_size += size if record else 0
    only = [v for v in h.variables.values() if v.record]
    if len(only) == 1:  # a lone record variable is not padded
        h.record_size = int(np.prod(h.shape(only[0].name)[1:], dtype=np.int64)) * np.dtype(only[0].dtype).itemsize
    return h


def read_box(f, h: Header, name: str, start: tuple[int, ...], size: tuple[int, ...]) -> np.ndarray:
    """A box of a variable, slowest dimension first."""
    v, shape = h.variables[name], h.shape(name)
    dtype = np.dtype(v.dtype)
    if any(a < 0 or n < 0 or a + n > s for a, n, s in zip(start, size, shape, strict=True)):
        raise ValueError(f"box {start} {size} is not in {shape}")
    out = np.empty(size, dtype=dtype)
    if not out.size:
        return out
    stride = [dtype.itemsize] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        stride[k] = stride[k + 1] * shape[k + 1]
    if v.record:
        stride[0] = h.record_size
    run = len(shape) - 1  # dimensions from here on are contiguous in the file
    while run > (1 if v.record else 0) and size[run] == shape[run]:
        run -= 1
    n = int(np.prod(size[run:], dtype=np.int64))
    flat = out.reshape(-1, n)
    for k, at in enumerate(itertools.product(*(range(a, a + c) for a, c in zip(start[:run], size[:run], strict=True)))):
        pos = v.begin + sum(i * s for i, s in zip((*at, *start[run:]), stride, strict=True))
        f.seek(pos)
        flat[k] = np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype)
    return out


def write(path: str, dims: list[tuple[str, int]], variables: dict[str, tuple[list[str], np.ndarray]], version: int = 2, record_dim: str | None = None) -> None:
    """Variables as (dimension names, array), slowest dimension first; ``record_dim`` may grow in the format."""
    index = {n: i for i, (n, _) in enumerate(dims)}
    code = {np.dtype(v).str: k for k, v in CODES.items()}
    i4, i8 = (lambda x: struct.pack(">i", x)), (lambda x: struct.pack(">q", x))
    num = i8 if version == 5 else i4
    off = i4 if version == 1 else i8
    text = lambda s: num(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    data = {n: (d, a.astype(np.dtype(a.dtype).newbyteorder(">"))) for n, (d, a) in variables.items()}
    records = next((a.shape[0] for d, a in data.values() if d and d[0] == record_dim), 0)
    fixed = {n: x for n, x in data.items() if not (x[0] and x[0][0] == record_dim)}
    grown = {n: x for n, x in data.items() if n not in fixed}

    def size(a: np.ndarray, rec: bool) -> int:
        n = a.nbytes // max(1, a.shape[0]) if rec else a.nbytes
        return n + -n % 4

    def header(begin: dict[str, int]) -> bytes:
        out = b"CDF" + bytes([version]) + num(records) + (i4(_DIMENSION) + num(len(dims)) if dims else i4(0) + num(0))
        for n, s in dims:
            out += text(n) + num(0 if n == record_dim else s)
        out += i4(0) + num(0) + i4(_VARIABLE) + num(len(data))
        for n, (d, a) in data.items():
            out += text(n) + num(len(d)) + b"".join(num(index[x]) for x in d) + i4(0) + num(0)
            out += i4(code[a.dtype.str]) + num(size(a, n in grown)) + off(begin.get(n, 0))
        return out

    at, begin = len(header({})), {}
    for n, (_, a) in fixed.items():
        begin[n] = at
        at += size(a, False)
    lone = len(grown) == 1
    for n, (_, a) in grown.items():
        begin[n] = at
        at += size(a, True)
    with _create(path) as f:
        f.write(header(begin))
        for _, a in fixed.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 4))
        for r in range(records):
            for _, a in grown.values():
                b = a[r].tobytes()
                f.write(b + (b"" if lone else b"\0" * (-len(b) % 4)))


def read_many(paths: list[str], name: str, start: tuple[int, ...], size: tuple[int, ...], steps: list[int] | None = None) -> np.ndarray:
    """A box of a variable that goes on over several files along its slowest dimension."""
    parts, first = [], 0
    for k, p in enumerate(paths):
        with _open(p) as f:
            h = read_header(f)
            n = steps[k] if steps else h.shape(name)[0]
            a, b = max(start[0], first), min(start[0] + size[0], first + n)
            if a < b:
                parts.append(read_box(f, h, name, (a - first, *start[1:]), (b - a, *size[1:])))
        first += n
    if sum(len(p) for p in parts) != size[0]:
        raise ValueError("the files don't hold that many steps")
    return np.concatenate(parts)


@dataclass
class Slab(InputPartition):
    path: str
    offset: int
    first: int
    count: int

    def __init__(self, path, offset, first, count):
        super().__init__(None)
        self.path, self.offset, self.first, self.count = path, offset, first, count


class NetcdfReader(DataSourceReader):
    """A row for each vertex: coordinates as whole numbers (fastest dimension first), then the variables."""

    def __init__(self, paths: list[str], names: list[str], schema: T.StructType, slab_bytes: int):
        self.paths, self.names, self.schema, self.slab_bytes = paths, names, schema, slab_bytes
        self.bounds: dict[str, list[int]] = {}

    def pushFilters(self, filters):
        axes = {f.name for f in self.schema} - set(self.names)
        for x in filters:
            op, col = type(x), x.attribute[0] if len(x.attribute) == 1 else None
            if col in axes and op in (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                vals = list(x.value) if op is In else [x.value]
                b = self.bounds.setdefault(col, [-(1 << 62), 1 << 62])
                if vals and op in (EqualTo, In, GreaterThan, GreaterThanOrEqual):
                    b[0] = max(b[0], min(vals) + (op is GreaterThan))
                if vals and op in (EqualTo, In, LessThan, LessThanOrEqual):
                    b[1] = min(b[1], max(vals) - (op is LessThan))
                if op is In:
                    yield x
            else:
                yield x

    def _box(self, dims: list[str], shape: tuple[int, ...]):
        out = []
        for d, n in zip(dims, shape, strict=True):
            lo, hi = self.bounds.get(d, (0, n - 1))
            lo, hi = max(0, lo), min(n - 1, hi)
            out.append((lo, max(0, hi - lo + 1)))
        return out

    def partitions(self):
        out, offset = [], 0
        for p in self.paths:
            with _open(p) as f:
                h = read_header(f)
            shape, dims = h.shape(self.names[0]), h.dim_names(self.names[0])
            lo, hi = self.bounds.get(dims[0], (0, 1 << 62))
            a, b = max(0, lo - offset), min(shape[0] - 1, hi - offset)
            row = int(np.prod(shape[1:], dtype=np.int64)) * 4 * len(self.names)
            step = max(1, self.slab_bytes // max(1, row))
            out += [Slab(p, offset, s, min(step, b - s + 1)) for s in range(a, b + 1, step)]
            offset += shape[0]
        return out or [Slab("", 0, 0, 0)]

    def read(self, s: Slab) -> Iterator[pa.RecordBatch]:
        if not s.count:
            return
        with _open(s.path) as f:
            h = read_header(f)
            shape, dims = h.shape(self.names[0]), h.dim_names(self.names[0])
            box = self._box(dims[1:], shape[1:])
            start, size = (s.first, *(a for a, _ in box)), (s.count, *(n for _, n in box))
            data = {n: read_box(f, h, n, start, size).reshape(-1) for n in self.names}
        at = np.unravel_index(np.arange(int(np.prod(size, dtype=np.int64))), size)
        cols = {d: (at[k] + start[k] + (s.offset if k == 0 else 0)).astype(np.int32) for k, d in enumerate(dims)}
        cols |= {n: v.astype(v.dtype.newbyteorder("=")) for n, v in data.items()}
        names = [x.name for x in self.schema]
        for i in range(0, len(at[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(cols[c][i : i + (1 << 18)]) for c in names], names=names)


class NetcdfSource(DataSource):
    """Options: path (comma-separated files, joined along the slowest dimension), variables, slab_bytes."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _paths(self) -> list[str]:
        return [p.strip() for p in self.options["path"].split(",")]

    def _names(self, h: Header) -> list[str]:
        given = self.options.get("variables")
        return [v.strip() for v in given.split(",")] if given else list(h.variables)

    def schema(self):
        with _open(self._paths()[0]) as f:
            h = read_header(f)
        names = self._names(h)
        axes = [T.StructField(d, T.IntegerType()) for d in reversed(h.dim_names(names[0]))]
        return T.StructType(axes + [T.StructField(n, SPARK[h.variables[n].dtype]) for n in names])

    def reader(self, schema):
        with _open(self._paths()[0]) as f:
            names = self._names(read_header(f))
        return NetcdfReader(self._paths(), names, schema, int(self.options.get("slab_bytes", 8 << 20)))


def register(spark) -> None:
    spark.dataSource.register(NetcdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
