"""Arrays in ``.npy`` files, read and written by the executors.

A stored array is a folder of chunks, each some rows of the first axis as one ``.npy`` file,
and a manifest. Tasks write a chunk each and read only the bytes of the cells that they are
asked for, so arrays of any size go in and out without passing through the driver, which sees
manifests and headers alone. A view of such an array, or of a single file, may have strides
and an offset of its own. The path must be one that driver and executors see as files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tensorloom.errors import OffsetOverflow, ScalarConversion, ShapeMismatch, StrideLengthMismatch
from tensorloom.plans.planner import row_major_strides
from tensorloom.tensor import Tensor

FORMAT, MANIFEST = "npy_chunks", "manifest.json"
#: Cells that a task reads, and bytes of a chunk.
CELLS, CHUNK = 1 << 20, 32 << 20


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class StoredArray:
    """Elements of a folder of chunks, or of one file, by their number in row-major order (a file's own order, if it is column-major)."""

    def __init__(self, path: str) -> None:
        self.path = _local(path)
        if self.path.endswith(".npy"):
            one = np.load(self.path, mmap_mode="r")
            self.dims, self.dtype, self.fortran = one.shape, one.dtype, bool(one.ndim > 1 and one.flags.f_contiguous and not one.flags.c_contiguous)
            self.step, self.chunks = max(1, one.size), {0: os.path.basename(self.path)}
            self.path = os.path.dirname(self.path)
        else:
            with open(f"{self.path}/{MANIFEST}", encoding="utf-8") as f:
                found = json.load(f)
            self.dims, self.dtype, self.fortran = tuple(found["dims"]), np.dtype(found["dtype"]), False
            self.step, self.chunks = found["rows"] * prod(self.dims[1:]), {int(k): v for k, v in found["chunks"].items()}
        if self.dtype.kind not in "fiucb":
            raise ScalarConversion(f"values of {self.dtype} are not numbers")

    def strides(self) -> list[int]:
        return [prod(self.dims[:k]) for k in range(len(self.dims))] if self.fortran else row_major_strides(self.dims)

    def take(self, at: np.ndarray) -> np.ndarray:
        """The elements of these numbers; of files only the pages they lie in are read."""
        out = np.zeros(len(at), dtype=self.dtype)
        which = at // self.step
        for k in np.unique(which):
            if int(k) in self.chunks:  # a chunk without any cell is not stored
                flat = np.load(f"{self.path}/{self.chunks[int(k)]}", mmap_mode="r").reshape(-1, order="F" if self.fortran else "C")
                mine = which == k
                out[mine] = flat[at[mine] - k * self.step]
        return out


@dataclass
class Span(InputPartition):
    """Cells ``first`` to ``end`` of a view, in its row-major order."""

    first: int
    end: int


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.dims, self.strides, self.offset = json.loads(options["dims"]), json.loads(options["strides"]), int(options["offset"])
        self.cells = int(options.get("cells", CELLS))

    def partitions(self) -> Sequence[InputPartition]:
        n = prod(self.dims)
        return [Span(k, min(n, k + self.cells)) for k in range(0, n, self.cells)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        array = StoredArray(self.path)
        for first in range(partition.first, partition.end, 1 << 16):
            cells = np.arange(first, min(partition.end, first + (1 << 16)))
            index = np.unravel_index(cells, self.dims) if self.dims else ()
            at = np.full(len(cells), self.offset, dtype=np.int64)
            for i, s in zip(index, self.strides, strict=True):
                at += i * s
            values = array.take(at)
            parts = {"re": values.real.astype(float), "im": values.imag.astype(float)} if values.dtype.kind == "c" else {"v": values.astype(float if values.dtype.kind == "f" else np.int64)}
            columns = {f"a{k}": i.astype(np.int64) for k, i in enumerate(index)} | parts
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


@dataclass
class Written(WriterCommitMessage):
    chunks: dict


class ChunkWriter(DataSourceArrowWriter):
    """Rows ``block, a0, a1, ..., values`` by block -> a file a block, under a name of its own, which the manifest takes in when all tasks are done."""

    def __init__(self, options: dict) -> None:
        self.path, self.dims, self.rows, self.dtype = _local(options["path"]), json.loads(options["dims"]), int(options["rows"]), options["dtype"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        done: dict[int, str] = {}
        now, chunk = None, None

        def close() -> None:
            if now is not None:
                name = f"chunk-{now:08d}-{uuid.uuid4().hex}.npy"
                with open(f"{self.path}/.{name}", "wb") as f:
                    np.save(f, chunk)
                os.replace(f"{self.path}/.{name}", f"{self.path}/{name}")
                done[now] = name

        for b in iterator:
            columns = {n: b.column(k).to_numpy() for k, n in enumerate(b.schema.names)}
            values = columns["re"] + 1j * columns["im"] if "re" in columns else columns["v"]
            for block in np.unique(columns["block"]):
                if block != now:
                    close()
                    now = int(block)
                    chunk = np.zeros((min(self.rows, self.dims[0] - now * self.rows), *self.dims[1:]), dtype=self.dtype)
                mine = columns["block"] == block
                chunk[tuple(columns[f"a{k}"][mine] - (now * self.rows if k == 0 else 0) for k in range(len(self.dims)))] = values[mine]
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        chunks = {k: v for m in messages if m is not None for k, v in m.chunks.items()}
        with open(f"{self.path}/.{MANIFEST}", "w", encoding="utf-8") as f:
            json.dump({"dims": self.dims, "dtype": self.dtype, "rows": self.rows, "chunks": chunks}, f)
        os.replace(f"{self.path}/.{MANIFEST}", f"{self.path}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        for m in messages:
            for name in m.chunks.values() if m is not None else ():
                if os.path.exists(f"{self.path}/{name}"):
                    os.remove(f"{self.path}/{name}")


class NpyChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ChunkWriter(self.options)


def from_file(spark: SparkSession, path: str, dims: Sequence[int] | None = None, strides: Sequence[int] | None = None, offset: int = 0, *, checked: bool = True, cells: int = CELLS) -> Tensor:
    """A stored array, or a strided view of it: cell ``i`` is element ``offset + sum(i * stride)``.

    Strides count elements and may be negative or 0. ``dims`` without strides read the
    elements in row-major order under another shape. A view that reaches outside is an
    ``OffsetOverflow`` unless it is not ``checked``.
    """
    array = StoredArray(path)
    own = dims is None
    dims = list(array.dims if own else dims)
    strides = list(array.strides() if own else row_major_strides(dims)) if strides is None else list(strides)
    if len(dims) != len(strides):
        raise StrideLengthMismatch(f"{len(dims)} dims and {len(strides)} strides")
    ends = [(n - 1) * s for n, s in zip(dims, strides, strict=True)]
    if checked and prod(dims) and (offset + sum(min(0, e) for e in ends) < 0 or offset + sum(max(0, e) for e in ends) >= prod(array.dims)):
        raise OffsetOverflow(f"the view reaches outside {prod(array.dims)} values")
    kind = "complex" if array.dtype.kind == "c" else "real"
    columns = ", ".join([f"a{k} long" for k in range(len(dims))] + (["re double", "im double"] if kind == "complex" else ["v double" if array.dtype.kind == "f" else "v long"]))
    spark.dataSource.register(NpyChunks)
    options = {"path": path, "dims": json.dumps(dims), "strides": json.dumps(strides), "offset": str(offset), "cells": str(cells), "columns": columns}
    return Tensor(spark.read.format(FORMAT).options(**options).load(), dims, kind, cells=float(prod(dims)))


def write_chunks(t: Tensor, path: str, *, rows: int | None = None) -> None:
    """Store a tensor of known sizes as chunks of ``rows`` of its first axis; absent cells are zero.

    A task writes its chunks under names of their own, so one that is run again leaves nothing
    double, and the manifest appears last.
    """
    if None in t.dims or not t.rank:
        raise ShapeMismatch("an axis is needed, and all sizes")
    rows = rows or max(1, CHUNK // (16 * max(1, prod(t.dims[1:]))))
    here = t.resolved()
    whole = not here.is_complex() and dict(here.df.dtypes)["v"] in ("bigint", "int")
    dtype = "complex128" if here.is_complex() else "int64" if whole else "float64"
    here.df.sparkSession.dataSource.register(NpyChunks)
    dealt = here.df.select(F.expr(f"a0 div {rows}").alias("block"), *here.axes, *[F.col(v).cast("long" if whole else "double").alias(v) for v in here.values]).repartition("block").sortWithinPartitions("block")
    columns = ", ".join(f"{n} {kind}" for n, kind in dealt.dtypes)
    dealt.write.format(FORMAT).options(path=path, dims=json.dumps(list(here.dims)), rows=str(rows), dtype=dtype, columns=columns).mode("append").save()
