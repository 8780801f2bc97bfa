"""Shared pieces: table access, the shared work folder, code shipping, byte hashing, components."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..workspace import Workspace

__all__ = ["RollingHash", "Workspace", "claim", "components", "fresh", "keeps", "mix", "ship", "table", "trim"]

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, where the session names no bound: rows may be long texts.
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path has it, and bound the batches they get."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    context = spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif context.applicationId not in _shipped:
        # executors need not see the driver's folders: the package goes to them as a file
        _shipped.add(context.applicationId)
        path = Path(tempfile.mkdtemp()) / "skein-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(Path(ROOT, "skein").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        context.addPyFile(str(path))


_shipped: set[str] = set()


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_caches: dict[str, object] = {}
_owner = ""


def trim() -> None:
    """Give freed memory of this worker back to the system: workers outlive tasks and share the executor's bound."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def keeps(owner: str, clear) -> None:
    """Name what empties an operator's per-process tables."""
    _caches[owner] = clear


def claim(owner: str) -> None:
    """At a task's start: tables of the operators that ran in this worker before go."""
    global _owner
    if owner != _owner:
        for name, clear in _caches.items():
            if name != owner:
                clear()
        _owner = owner
        trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes, modulo 2**64, of any span of a byte array from one prefix sum.

    With an odd base r the inverse powers exist, so the hash of bytes i..j is
    (S[j] - S[i]) * r**-i where S sums table[b] * r**i.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 7):
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            inverse = pow(self.BASE, -1, 2**64)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, self.BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse, np.uint64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = len(sums) - k
        return mix((sums[k:] - sums[:n]) * self.down[:n])
