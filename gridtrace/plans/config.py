"""Run and dataset descriptions, and their XML form."""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

TYPES = {"INT8": "i1", "INT16": "i2", "INT32": "i4", "INT64": "i8", "FLOAT32": "f4", "FLOAT64": "f8"}


@dataclass
class TraceConfig:
    num_blocks: int = 1
    nb_per_proc: int = 1
    ghost_size: int = 1
    epoch_size: int = 250
    num_threads: int = 1
    elastic_ghost: bool = False
    block_mem_limit: int = 64
    debug: bool = False
    kd_tree: bool = False
    space_only: bool = False

    def blocks(self, n_procs: int) -> int:
        """Blocks in all: so many a process where that is set."""
        return self.nb_per_proc * n_procs if self.nb_per_proc >= 1 else self.num_blocks

    @property
    def constrained(self) -> bool:
        """A negative memory limit replicates the field, and splits need no bounds."""
        return self.block_mem_limit >= 0


@dataclass
class Run:
    run_id: int
    directory: str
    pattern: str
    filenames: list[str] = field(default_factory=list)


@dataclass
class Variable:
    name: str
    data_type: str = "FLOAT32"
    big_endian: bool = False


@dataclass
class Dimension:
    name: str
    size: int
    storage_order: int = 0


@dataclass
class Dataset:
    name: str
    runs: list[Run] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    timesteps_per_file: list[int] = field(default_factory=list)

    @property
    def size(self) -> tuple[int, ...]:
        return tuple(d.size for d in self.dimensions)

    def check(self, config: TraceConfig) -> None:
        if len(self.dimensions) not in (2, 3, 4):
            raise ValueError("a field has 2, 3 or 4 dimensions")
        if config.space_only and len(self.dimensions) != 4:
            raise ValueError("only a field with time can be cut in space only")


def parse_xml(text: str, find_files: bool = True) -> tuple[TraceConfig, Dataset]:
    """A <config> and a <dataset> element, side by side or in one root. No file for a run is an error."""
    root = ET.fromstring(f"<all>{text}</all>" if not text.lstrip().startswith("<?xml") else f"<all>{text.split('?>', 1)[1]}</all>")
    c, d = root.find(".//config"), root.find(".//dataset")
    config = TraceConfig()
    if c is not None:
        for key, value in c.attrib.items():
            if hasattr(config, key) and not isinstance(getattr(type(config), key, None), property):
                old = getattr(config, key)
                setattr(config, key, value.lower() in ("1", "true") if isinstance(old, bool) else int(value))
    data = Dataset(d.get("name", ""))
    for r in d.findall("run"):
        run = Run(int(r.get("run_id", 0)), r.get("directory", ""), r.get("pattern", "*"))
        if find_files:
            run.filenames = find(run.directory, run.pattern)
        data.runs.append(run)
    for v in d.findall("variable"):
        if v.get("data_type", "FLOAT32") not in TYPES:
            raise ValueError(f"unknown type {v.get('data_type')}")
        data.variables.append(Variable(v.get("name"), v.get("data_type", "FLOAT32"), v.get("big_endian", "0") in ("1", "true")))
    for m in d.findall("dimension"):
        data.dimensions.append(Dimension(m.get("name"), int(m.get("size", 0)), int(m.get("storage_order", 0))))
    return config, data


def find(directory: str, pattern: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(directory, pattern)))
    if not found:
        raise FileNotFoundError(f"no file matches {pattern} in {directory}")
    return found


def infer_time(data: Dataset, first_dim_of) -> Dataset:
    """Fill the time extent from the files' own first dimension, run by run."""
    data.timesteps_per_file = [first_dim_of(f) for f in data.runs[0].filenames]
    data.dimensions[3].size = sum(data.timesteps_per_file)
    return data
