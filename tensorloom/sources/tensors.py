"""Where tensors come from and go to: tables, NumPy arrays, strided buffers, functions, Parquet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import prod
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import OffsetOverflow, RankMismatch, ScalarConversion, ShapeMismatch, StrideLengthMismatch
from tensorloom.plans.planner import column_major_strides, row_major_strides
from tensorloom.tensor import Tensor, axis, index_grid


def from_table(df: DataFrame, keys: Sequence[str | Column], value: str | Column, dims: Sequence[int | None] | None = None, *, imag: str | Column | None = None, unique: bool = False, exact: bool = False, cells: float | None = None) -> Tensor:
    """Sum of ``value`` by ``keys``; rows with a null key or value are left out.

    Keys become longs. The sum is what makes coordinates unique; it is skipped only
    where the caller knows they are (``unique``). ``exact`` sums doubles without rounding
    on the way, so that the result is the same for any order of rows.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    names = ["re", "im"] if imag is not None else ["v"]
    values = [as_column(value)] + ([as_column(imag)] if imag is not None else [])
    rows = df.select(*[as_column(k).cast("long").alias(axis(n)) for n, k in enumerate(keys)], *[v.alias(n) for n, v in zip(names, values, strict=True)])
    rows = rows.where(reduce(and_, [F.col(c).isNotNull() for c in rows.columns]))
    axes = [axis(n) for n in range(len(keys))]
    if exact and not unique:
        from tensorloom.functions.exact import exact_total

        cells_ = Tensor(rows, dims or [None] * len(keys), "complex" if imag is not None else "real")
        return exact_total(cells_, cells_.parts(), range(len(keys)), cells_.dims)
    if not unique:
        rows = rows.groupBy(*axes).agg(*[F.sum(n).alias(n) for n in names])
    return Tensor(rows, dims if dims is not None else [None] * len(keys), "complex" if imag is not None else "real", cells=cells)


def indicator(df: DataFrame, keys: Sequence[str | Column], dims: Sequence[int | None] | None = None, *, unique: bool = False) -> Tensor:
    """1 at the key tuples that occur, as from a foreign key; ``unique`` if each occurs once."""
    t = from_table(df if unique else df.select(*keys).distinct(), keys, F.lit(1.0), dims, unique=True)
    return t


def from_array_column(df: DataFrame, keys: Sequence[str], array: str, dims: Sequence[int | None] | None = None, *, cast: Callable[[Column], Column] | None = None) -> Tensor:
    """One more axis for the places in an array column."""
    rows = df.select(*[F.col(k).cast("long").alias(axis(n)) for n, k in enumerate(keys)], F.posexplode(array).alias("p", "v"))
    v = cast(F.col("v")) if cast else F.col("v")
    last = axis(len(keys))
    return Tensor(rows.select(*[axis(n) for n in range(len(keys))], F.col("p").cast("long").alias(last), v.alias("v")), dims or [None] * (len(keys) + 1))


def from_numpy(spark: SparkSession, array: np.ndarray) -> Tensor:
    """All cells of an array of any layout; complex and real kinds, integers as they are."""
    array = np.asarray(array)
    if array.dtype.kind not in "fiucb":
        raise ScalarConversion(f"values of {array.dtype} are not numbers")
    index = np.indices(array.shape).reshape(array.ndim, array.size)
    flat = array.reshape(-1)
    kind = "complex" if array.dtype.kind == "c" else "real"
    columns = {axis(k): index[k].astype(np.int64) for k in range(array.ndim)}
    columns |= {"re": flat.real.astype(float), "im": flat.imag.astype(float)} if kind == "complex" else {"v": flat}
    import pandas as pd

    schema = ", ".join([f"{axis(k)} long" for k in range(array.ndim)] + (["re double", "im double"] if kind == "complex" else ["v " + {"f": "double", "b": "boolean"}.get(array.dtype.kind, "long")]))
    return Tensor(spark.createDataFrame(pd.DataFrame(columns), schema), array.shape, kind, cells=float(array.size))


def to_numpy(t: Tensor) -> np.ndarray:
    """Collected and dense, in axis order; absent cells are zero."""
    if None in t.dims:
        raise ShapeMismatch("not all sizes are known")
    rows = t.resolved().df.toPandas()
    out = np.zeros(t.dims, dtype=complex if t.is_complex() else float)
    value = rows["re"].to_numpy() + 1j * rows["im"].to_numpy() if t.is_complex() else rows["v"].to_numpy()
    out[tuple(rows[a].to_numpy(dtype=int) for a in t.axes)] = value if t.rank else value[0]
    return out


def to_buffer(t: Tensor, order: str = "column") -> list:
    """Values in memory order, column-major or row-major."""
    return to_numpy(t).reshape(-1, order="F" if order == "column" else "C").tolist()


def from_buffer(spark: SparkSession, data: Sequence, dims: Sequence[int], strides: Sequence[int], offset: int = 0, *, checked: bool = True) -> Tensor:
    """A strided view: cell ``i`` is ``data[offset + sum(i * stride)]``. Strides may be negative or 0."""
    if len(dims) != len(strides):
        raise StrideLengthMismatch(f"{len(dims)} dims and {len(strides)} strides")
    if checked and prod(dims):
        ends = [(n - 1) * s for n, s in zip(dims, strides, strict=True)]
        if offset + sum(min(0, e) for e in ends) < 0 or offset + sum(max(0, e) for e in ends) >= len(data):
            raise OffsetOverflow(f"the view reaches outside {len(data)} values")
    complex_ = any(isinstance(x, complex) for x in data)
    values = [(k, complex(x).real, complex(x).imag) for k, x in enumerate(data)] if complex_ else [(k, float(x)) for k, x in enumerate(data)]
    buffer = spark.createDataFrame(values, "at long, re double, im double" if complex_ else "at long, v double")
    at = F.lit(offset).cast("long")
    for k, s in enumerate(strides):
        at = at + F.col(axis(k)) * F.lit(s)
    grid = index_grid(spark, dims).withColumn("at", at)
    t = Tensor(grid.join(buffer, "at").drop("at"), dims, "complex" if complex_ else "real", cells=float(prod(dims)))
    return Tensor(t.df.select(*t.axes, *t.values), dims, t.dtype, cells=t.cells)


def from_parts(spark: SparkSession, data: Sequence, dims: Sequence[int], *, order: str = "column") -> Tensor:
    """A whole buffer in one of the two standard layouts."""
    return from_buffer(spark, data, dims, column_major_strides(dims) if order == "column" else row_major_strides(dims))


def zeros(spark: SparkSession, dims: Sequence[int], dtype: str = "real") -> Tensor:
    """A row of zero for every cell."""
    names = ["v"] if dtype == "real" else ["re", "im"]
    grid = index_grid(spark, dims)
    return Tensor(grid.select("*", *[F.lit(0.0).alias(n) for n in names]), dims, dtype, cells=float(prod(dims)))


def from_fn(spark: SparkSession, dims: Sequence[int], f: Callable[..., Column]) -> Tensor:
    """Values by a function of the index columns."""
    grid = index_grid(spark, dims)
    return Tensor(grid.select("*", f(*[F.col(axis(k)) for k in range(len(dims))]).alias("v")), dims, cells=float(prod(dims)))


def write_parquet(t: Tensor, path: str, *, partition_by_first: bool = False) -> None:
    """Coordinates and values; the first axis may be a partition column, for pruning."""
    writer = t.resolved().df.write.mode("overwrite")
    (writer.partitionBy(axis(0)) if partition_by_first else writer).parquet(path)


def read_parquet(spark: SparkSession, path: str, dims: Sequence[int | None]) -> Tensor:
    df = spark.read.parquet(path)
    found = sum(c.startswith("a") for c in df.columns)
    if found != len(dims):
        raise RankMismatch(f"{found} axes stored, {len(dims)} sizes given")
    df = df.withColumns({axis(k): F.col(axis(k)).cast("long") for k in range(found)})
    return Tensor(df, dims, "complex" if "re" in df.columns else "real")
