"""Raw binary bricks, .npy files and the interleaved converter: boxes by seeks, Spark source and writers."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def runs(shape: tuple[int, ...], start: tuple[int, ...], size: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """(offset, length) in elements of each contiguous run of a box, slowest dimension first."""
    k = len(shape) - 1
    while k > 0 and size[k] == shape[k]:
        k -= 1
    n = int(np.prod(size[k:], dtype=np.int64))
    strides = [int(np.prod(shape[i + 1 :], dtype=np.int64)) for i in range(len(shape))]
    for at in itertools.product(*(range(a, a + c) for a, c in zip(start[:k], size[:k], strict=True))):
        yield sum(i * s for i, s in zip((*at, *start[k:]), strides, strict=True)), n


def read_box(path: str, shape, start, size, dtype="<f4", header: int = 0, chunk: int = 1) -> np.ndarray:
    """A box of a raw array; with ``chunk`` each element is so many values."""
    item = np.dtype(dtype).itemsize * chunk
    out = np.empty((int(np.prod(size, dtype=np.int64)), chunk), dtype=dtype)
    at = 0
    with open(path, "rb") as f:
        for offset, n in runs(tuple(shape), tuple(start), tuple(size)):
            f.seek(header + offset * item)
            out[at : at + n] = np.frombuffer(f.read(n * item), dtype=dtype).reshape(n, chunk)
            at += n
    return out.reshape((*size, chunk) if chunk > 1 else size)


def create(path: str, shape, dtype="<f4", header: bytes = b"") -> None:
    """A file of the right length, to be filled by boxes from several tasks."""
    with open(path, "wb") as f:
        f.write(header)
        f.truncate(len(header) + int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize)


def write_box(path: str, shape, start, data: np.ndarray, core: tuple | None = None, header: int = 0) -> None:
    """Write an array, or its sub-box ``core`` = (offsets, sizes), at ``start`` of a file made before."""
    if core:
        data = data[tuple(slice(a, a + n) for a, n in zip(*core, strict=True))]
    flat, at, item = np.ascontiguousarray(data).reshape(-1), 0, data.dtype.itemsize
    with open(path, "r+b") as f:
        for offset, n in runs(tuple(shape), tuple(start), data.shape):
            f.seek(header + offset * item)
            f.write(flat[at : at + n].tobytes())
            at += n


def write_bricks(bricks, path: str, shape, dtype="<f4") -> None:
    """Each block's rows (start array, shape array, data) into one shared file, from the executors.

    The path must be in a folder that all executors share.
    """
    create(path, shape, dtype)

    def put(batches):
        for b in batches:
            for r in b.itertuples():
                write_box(path, shape, tuple(r.start), np.frombuffer(r.data, dtype=dtype).reshape(tuple(r.shape)))
                yield b.iloc[:0][["gid"]]

    bricks.mapInPandas(put, "gid int").count()


# --- .npy ------------------------------------------------------------------------------------------


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the data begin. Fortran order is refused."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
        if fortran:
            raise ValueError("Fortran order is not supported")
        return shape, dtype, f.tell()


def npy_header_bytes(shape: tuple[int, ...], dtype) -> bytes:
    """A header, padded so that data begin at a multiple of 16."""
    body = f"{{'descr': '{np.dtype(dtype).str}', 'fortran_order': False, 'shape': {tuple(shape)!r}, }}".encode()
    body += b" " * (-(len(body) + 11) % 16) + b"\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(body)) + body


def read_npy_box(path: str, start, size) -> np.ndarray:
    shape, dtype, at = npy_header(path)
    return read_box(path, shape, start, size, dtype, at)


def write_npy(path: str, shape, dtype, boxes: list[tuple[tuple[int, ...], np.ndarray]]) -> None:
    head = npy_header_bytes(shape, dtype)
    create(path, shape, dtype, head)
    for start, data in boxes:
        write_box(path, shape, start, data.astype(dtype), header=len(head))


# --- converter -------------------------------------------------------------------------------------


def deinterleave(path: str, shape: tuple[int, ...], n_vars: int = 3, dtype: str = ">f4", step: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """Interleaved values of several variables, as (first vertex, array (variables, vertices)), in native order."""
    total, item = int(np.prod(shape, dtype=np.int64)), np.dtype(dtype).itemsize
    with open(path, "rb") as f:
        for first in range(0, total, step):
            n = min(step, total - first)
            part = np.frombuffer(f.read(n * n_vars * item), dtype=dtype).reshape(n, n_vars)
            yield first, part.T.astype(np.dtype(dtype).newbyteorder("="))


def convert(path: str, out: str, shape: tuple[int, ...], names: list[str], dtype: str = ">f4") -> None:
    """Interleaved raw data to a NetCDF file of one variable each."""
    from gridtrace.sources import netcdf

    data = [np.empty(int(np.prod(shape)), dtype=np.dtype(dtype).newbyteorder("=")) for _ in names]
    for first, part in deinterleave(path, shape, len(names), dtype):
        for d, v in zip(data, part, strict=True):
            d[first : first + part.shape[1]] = v
    dims = list(zip("tzyx"[-len(shape) :], shape, strict=True))
    netcdf.write(out, dims, {n: ([d for d, _ in dims], v.reshape(shape)) for n, v in zip(names, data, strict=True)})


# --- Spark source ----------------------------------------------------------------------------------


@dataclass
class Part(InputPartition):
    first: int
    count: int

    def __init__(self, first, count):
        super().__init__(None)
        self.first, self.count = first, count


class RawReader(DataSourceReader):
    def __init__(self, path, shape, dtype, header, slab):
        self.path, self.shape, self.dtype, self.header, self.slab = path, shape, dtype, header, slab

    def partitions(self):
        row = int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize
        step = max(1, self.slab // max(1, row))
        return [Part(s, min(step, self.shape[0] - s)) for s in range(0, self.shape[0], step)]

    def read(self, p: Part):
        size = (p.count, *self.shape[1:])
        v = read_box(self.path, self.shape, (p.first, *[0] * (len(size) - 1)), size, self.dtype, self.header).reshape(-1)
        at = np.unravel_index(np.arange(len(v)), size)
        names = list("xyzt"[: len(size)])
        cols = [pa.array((at[len(size) - 1 - k] + (p.first if k == len(size) - 1 else 0)).astype(np.int32)) for k in range(len(size))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(v.astype(np.dtype(self.dtype).newbyteorder("=")))], names=[*names, "value"])


class RawSource(DataSource):
    """Options: path, shape (comma-separated, slowest first), dtype, header bytes; a .npy path needs the path alone."""

    @classmethod
    def name(cls) -> str:
        return "brick"

    def _what(self):
        p = self.options["path"]
        if p.endswith(".npy"):
            shape, dtype, at = npy_header(p)
            return p, shape, dtype.str, at
        return p, tuple(int(s) for s in self.options["shape"].split(",")), self.options.get("dtype", "<f4"), int(self.options.get("header", 0))

    def schema(self):
        _, shape, dtype, _ = self._what()
        kind = {"f4": T.FloatType, "f8": T.DoubleType, "i1": T.ByteType, "i2": T.ShortType, "i4": T.IntegerType, "i8": T.LongType}[np.dtype(dtype).str[1:]]
        return T.StructType([*(T.StructField(a, T.IntegerType()) for a in "xyzt"[: len(shape)]), T.StructField("value", kind())])

    def reader(self, schema):
        return RawReader(*self._what(), int(self.options.get("slab_bytes", 8 << 20)))


def register(spark) -> None:
    spark.dataSource.register(RawSource)
