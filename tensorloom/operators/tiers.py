"""Matrices of tiles, for operands whose cells lie densely.

A tile is a square block of cells, built where its cells meet and multiplied by NumPy: a
product of m x k x n cells joins (m k n) / tile ** 3 pairs of tiles in place of m k n pairs
of cells. Each tile is dense, dense with a mask of its stored cells, or a list of places and
values, by its own count, so a matrix may be dense in one corner and sparse in others. The
product of tiles is tiles again: chains stay in this form until cells are asked for.

Which cells are stored is multiplied along: a cell of a product has a row exactly where some
pair of stored cells met, whatever the sum, and an infinite value meets stored cells alone.
So tiles and cells give the same rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Hashable, Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import DimensionMismatch, ShapeMismatch
from tensorloom.tensor import Tensor

#: Side of a tile: 256 x 256 doubles are half a megabyte.
TILE = 256
#: Pairs of cells above which a dense product goes by tiles.
BLOCKS_FROM = 50_000_000
#: Part of its cells that an operand must store to count as dense.
DENSE = 0.1
#: Products that a task sums before it sends them on, inner blocks that go together, and bytes of left tiles held in memory.
HELD, RUN, KEPT = 64, 32, 1 << 26
#: Part of its cells below which a tile is stored as places and values, and the pairs a stored cell of two such
#: tiles may make, as a part of the dense product's, for them to be multiplied so.
SPARSE, PAIRS = 0.25, 0.02

#: A column and its size; a group of one axis may leave its size open (None).
Axis = tuple[str, "int | None"]


class Tile:
    """Cells of a block, row by row: ``values`` whole with a ``mask`` (None: all are stored), or by ``at`` only those stored."""

    __slots__ = ("at", "mask", "values")

    def __init__(self, at: np.ndarray | None, mask: np.ndarray | None, values: np.ndarray) -> None:
        self.at, self.mask, self.values = at, mask, values

    @staticmethod
    def of(at: np.ndarray, values: np.ndarray, area: int) -> Tile:
        if len(at) < SPARSE * area:
            order = np.argsort(at, kind="stable")
            return Tile(at[order].astype(np.int32), None, values[order])
        whole = np.zeros(area, dtype=values.dtype)
        whole[at] = values
        if len(at) == area:
            return Tile(None, None, whole)
        mask = np.zeros(area, dtype=bool)
        mask[at] = True
        return Tile(None, mask, whole)

    def pack(self) -> tuple[bytes, bytes]:
        if self.at is not None:
            return b"s" + self.at.tobytes(), self.values.tobytes()
        return (b"f" if self.mask is None else b"m" + np.packbits(self.mask).tobytes()), self.values.tobytes()

    @staticmethod
    def unpack(where: bytes, data, kind: type, area: int) -> Tile:
        values = np.frombuffer(data, dtype=kind)
        if where[:1] == b"s":
            return Tile(np.frombuffer(where, dtype=np.int32, offset=1), None, values)
        return Tile(None, None if where[:1] == b"f" else np.unpackbits(np.frombuffer(where, dtype=np.uint8, offset=1), count=area).astype(bool), values)

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the stored cells."""
        if self.at is not None:
            return self.at.astype(np.int64), self.values
        at = np.arange(len(self.values)) if self.mask is None else np.flatnonzero(self.mask)
        return at, self.values[at]

    def flipped(self, side: int) -> Tile:
        if self.at is not None:
            at, values = self.stored()
            return Tile.of(at % side * side + at // side, values, side * side)
        turn = lambda x: np.ascontiguousarray(x.reshape(side, side).T).reshape(-1)
        return Tile(None, None if self.mask is None else turn(self.mask), turn(self.values))

    def square(self, side: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Values and mask as matrices, absent cells being zero."""
        if self.at is None:
            return self.values.reshape(side, side), None if self.mask is None else self.mask.reshape(side, side)
        whole, mask = np.zeros(side * side, dtype=self.values.dtype), np.zeros(side * side, dtype=bool)
        whole[self.at], mask[self.at] = self.values, True
        return whole.reshape(side, side), mask.reshape(side, side)


def dense_product(a: np.ndarray, stored_a: np.ndarray | None, b: np.ndarray, stored_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The product of two matrices, and where some pair of stored cells met (None: everywhere)."""
    full = stored_a is None and stored_b is None
    stored_a, stored_b = (np.ones(x.shape, dtype=bool) if m is None else m for x, m in ((a, stored_a), (b, stored_b)))
    met = None if full else stored_a.astype(np.float32) @ stored_b.astype(np.float32) > 0
    if a.dtype.kind == "i" and a.size and b.size:  # through doubles where these are exact
        most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
        if most < 2.0**53:
            return np.rint(a.astype(float) @ b.astype(float)).astype(np.int64), met
        if most >= 2.0**63:
            exact = a.astype(object) @ b.astype(object)
            if exact.max() >= 2**63 or exact.min() < -(2**63):
                raise OverflowError("a sum of products has no long")
            return exact.astype(np.int64), met
    if full or (np.isfinite(a).all() and np.isfinite(b).all()):
        return a @ b, met
    total = np.zeros((a.shape[0], b.shape[1]), dtype=np.result_type(a, b))
    for k in range(a.shape[1]):  # an infinite value times an absent cell is no product
        both = stored_a[:, k, None] & stored_b[None, k]
        with np.errstate(invalid="ignore"):
            total += np.where(both, a[:, k, None] * b[None, k], 0)
    return total, met


class Kept:
    """Rows that are read again and again: in memory up to ``most`` bytes, the others in a file of the task."""

    def __init__(self, most: int) -> None:
        self.most, self.rows, self.size, self.file = most, [], 0, None

    def add(self, row: tuple[int, bytes, bytes]) -> None:
        self.size += len(row[1]) + len(row[2])
        if self.size <= self.most:
            self.rows.append(row)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        pickle.dump(row, self.file, protocol=5)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        yield from self.rows
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)

    def clear(self) -> None:
        if self.file is not None:
            self.file.close()
        self.rows, self.size, self.file = [], 0, None


class Sum:
    """A tile of the result while products are added to it."""

    def __init__(self, side: int, kind: type) -> None:
        self.side, self.total, self.mask = side, np.zeros((side, side), dtype=kind), np.zeros((side, side), dtype=bool)

    def add(self, tile: Tile) -> None:
        if tile.at is not None:
            self.total.reshape(-1)[tile.at] += tile.values
            self.mask.reshape(-1)[tile.at] = True
            return
        values, mask = tile.square(self.side)
        self.total += values
        self.mask |= True if mask is None else mask

    def add_product(self, x: Tile, y: Tile) -> None:
        side = self.side
        if x.at is not None and y.at is not None:
            first = np.searchsorted(y.at, np.arange(side + 1) * side)
            n = np.diff(first)[x.at % side]
            if n.sum() <= PAIRS * side**3:
                left = np.repeat(np.arange(len(x.at)), n)
                right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[x.at % side], n)
                at = x.at[left].astype(np.int64) // side * side + y.at[right] % side
                np.add.at(self.total.reshape(-1), at, x.values[left] * y.values[right])
                self.mask.reshape(-1)[at] = True
                return
        (a, stored_a), (b, stored_b) = x.square(side), y.square(side)
        found, stored = dense_product(a, stored_a, b, stored_b)
        self.total += found
        self.mask |= True if stored is None else stored

    def tile(self) -> Tile:
        at = np.flatnonzero(self.mask)
        return Tile.of(at, self.total.reshape(-1)[at], self.side**2)


def _number(axes: Sequence[Axis]) -> Column:
    """Axes as one number, the last running fastest."""
    if len(axes) == 1:
        return F.col(axes[0][0])
    at = F.lit(0).cast("long")
    for name, n in axes:
        if n is None:
            raise ShapeMismatch(f"the size of {name} must be known beside other axes")
        at = at * F.lit(n) + F.col(name)
    return at


def _axes_of(number: str, axes: Sequence[Axis]) -> list[Column]:
    """``_number`` undone."""
    if len(axes) == 1:
        return [F.col(number).alias(axes[0][0])]
    steps = [prod(n for _, n in axes[k + 1 :]) for k in range(len(axes))]
    return [F.expr(f"({number} div {s}) % {n}").alias(name) for s, (name, n) in zip(steps, axes, strict=True)]


def keyed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Successive rows with equal keys, as slices of their batches."""
    now, held = None, []
    for one in batches:
        if not one.num_rows:
            continue
        columns = [one.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(one.num_rows - 1, dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), one.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(int(c[a]) for c in columns)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(one.slice(a, b - a))
    if held:
        yield now, held


TILES = "b long, bi long, bj long, place binary, data binary"


def _row(key: Sequence[int], tile: Tile) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], *[pa.array([x], pa.binary()) for x in tile.pack()]], ["b", "bi", "bj", "place", "data"])


class Tiled:
    """Tiles ``b, bi, bj, place, data`` of matrices: ``rows`` by ``cols``, one for each cell of ``batch``; see the module."""

    def __init__(self, df: DataFrame, batch: Sequence[Axis], rows: Sequence[Axis], cols: Sequence[Axis], kind: str, tile: int = TILE, flipped: bool = False) -> None:
        self.df, self.batch, self.rows, self.cols, self.kind, self.tile, self.flipped = df, list(batch), list(rows), list(cols), kind, tile, flipped

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.kind == "complex" else ["v"]

    @property
    def numpy(self) -> type:
        return {"complex": np.complex128, "double": np.float64, "long": np.int64}[self.kind]

    @staticmethod
    def of(df: DataFrame, batch: Sequence[Axis], rows: Sequence[Axis], cols: Sequence[Axis], values: Sequence[str], tile: int = TILE) -> Tiled:
        """Cells dealt out by tile, in one exchange. Whole numbers stay so."""
        whole = len(values) == 1 and dict(df.dtypes)[values[0]] in ("bigint", "int", "smallint", "tinyint")
        kind = "complex" if len(values) == 2 else "long" if whole else "double"
        numbered = df.select(_number(batch).alias("b") if batch else F.lit(0).cast("long").alias("b"), _number(rows).alias("r"), _number(cols).alias("c"), *[F.coalesce(F.col(v).cast("long" if whole else "double"), F.lit(0)).alias(v) for v in values])
        cells = numbered.select("b", F.expr(f"r div {tile}").alias("bi"), F.expr(f"c div {tile}").alias("bj"), (F.col("r") % tile * tile + F.col("c") % tile).cast("int").alias("at"), *values)
        found = Tiled(None, batch, rows, cols, kind, tile)
        area = tile * tile

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, slices in keyed(batches, 3):
                column = lambda k, slices=slices: np.concatenate([s.column(k).to_numpy() for s in slices])
                yield _row(key, Tile.of(column(3), column(4) if len(values) == 1 else column(4) + 1j * column(5), area))

        found.df = cells.repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj").mapInArrow(build, TILES)
        return found

    def transposed(self) -> Tiled:
        """No tile is touched until it is multiplied."""
        df = self.df.select("b", F.col("bj").alias("bi"), F.col("bi").alias("bj"), "place", "data")
        return Tiled(df, self.batch, self.cols, self.rows, self.kind, self.tile, not self.flipped)

    def times(self, other: Tiled) -> Tiled:
        """The products of the matrices, as tiles: pairs are multiplied where they meet, and
        only sums are shuffled. Neighbouring inner blocks go together, so that a task sums
        what falls on one tile of the result before it sends it on. Where the inner axes have
        few blocks, left tiles are dealt out by row block too, and right ones copied to each part."""
        if self.tile != other.tile or self.kind != other.kind:
            raise ShapeMismatch("tiles of one size and type are needed")
        side, kind, turned = self.tile, self.numpy, (self.flipped, other.flipped)
        tasks, inner = self.df.sparkSession.sparkContext.defaultParallelism, [n for _, n in self.cols]
        deep = None if None in inner else -(-prod(inner) // side) * prod(n or 1 for _, n in self.batch)
        parts = 2 if deep is None else max(1, min(tasks, -(-tasks // max(1, deep))))  # a depth that is not known is taken for a large one
        run = RUN if deep is None else max(1, min(RUN, deep // (4 * tasks)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        a = self.df.select("b", F.col("bj").alias("bk"), (F.col("bi") % parts).alias("part"), F.lit(0).alias("side"), F.col("bi").alias("at"), "place", "data")
        b = other.df.select("b", F.col("bi").alias("bk"), every.alias("part"), F.lit(1).alias("side"), F.col("bj").alias("at"), "place", "data")
        both = a.unionByName(b).withColumn("run", F.expr(f"bk div {run}")).repartition("b", "run", "part").sortWithinPartitions("b", "run", "part", "bk", "side", "at")

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Products summed by tile of the result as long as few tiles are held."""
            held: dict[tuple, Sum] = {}
            left, now = Kept(KEPT), None
            for one in batches:
                for k in range(one.num_rows):
                    batch, bk, part, which, at, place, data = (one.column(n)[k].as_py() for n in range(7))
                    if (batch, bk, part) != now:
                        now = batch, bk, part
                        left.clear()
                    if which == 0:
                        left.add((at, place, data))
                        continue
                    y = Tile.unpack(place, data, kind, side * side)
                    y = y.flipped(side) if turned[1] else y
                    for row, where, cells in left:
                        x = Tile.unpack(where, cells, kind, side * side)
                        key = batch, row, at
                        if key not in held:
                            if len(held) == HELD:
                                yield from (_row(place_, s.tile()) for place_, s in held.items())
                                held.clear()
                            held[key] = Sum(side, kind)
                        held[key].add_product(x.flipped(side) if turned[0] else x, y)
            yield from (_row(at, s.tile()) for at, s in held.items())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Products of one tile, which follow each other, summed."""
            now, total = None, None
            for one in batches:
                for k in range(one.num_rows):
                    key = tuple(one.column(n)[k].as_py() for n in range(3))
                    if key != now:
                        if now is not None:
                            yield _row(now, total.tile())
                        now, total = key, Sum(side, kind)
                    total.add(Tile.unpack(one.column(3)[k].as_py(), one.column(4)[k].as_buffer(), kind, side * side))
            if now is not None:
                yield _row(now, total.tile())

        products = both.drop("run").mapInArrow(multiply, TILES)
        summed = products.repartition("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj").mapInArrow(add, TILES)
        return Tiled(summed, self.batch, self.rows, other.cols, self.kind, side)

    def cells(self) -> DataFrame:
        """Axes by name and values, a row for every stored cell."""
        side, kind, turned, values = self.tile, self.numpy, self.flipped, self.values

        def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in batches:
                for k in range(one.num_rows):
                    b, i, j = (one.column(n)[k].as_py() for n in range(3))
                    tile = Tile.unpack(one.column(3)[k].as_py(), one.column(4)[k].as_buffer(), kind, side * side)
                    at, found = (tile.flipped(side) if turned else tile).stored()
                    parts = [found] if len(values) == 1 else [found.real, found.imag]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(at), b), at // side + i * side, at % side + j * side, *parts)], ["b", "r", "c", *values])

        rows = self.df.mapInArrow(open_, "b long, r long, c long, " + ", ".join(f"{v} {'long' if self.kind == 'long' else 'double'}" for v in values))
        return rows.select(*(_axes_of("b", self.batch) if self.batch else []), *_axes_of("r", self.rows), *_axes_of("c", self.cols), *values)

    def write(self, path: str) -> None:
        """Tiles as Parquet, sorted so that a range of rows is a range of files' row groups."""
        self.df.repartitionByRange("b", "bi", "bj").sortWithinPartitions("b", "bi", "bj").write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, batch: Sequence[Axis], rows: Sequence[Axis], cols: Sequence[Axis], kind: str = "double", tile: int = TILE) -> Tiled:
        return Tiled(spark.read.schema(TILES).parquet(path), batch, rows, cols, kind, tile)


def tiled(t: Tensor, tile: int = TILE) -> Tiled:
    """A tensor of two axes as tiles, over axes ``a0`` and ``a1``; sizes need not be known."""
    t.need_rank(2)
    return Tiled.of(t.resolved().df, [], [("a0", t.dims[0])], [("a1", t.dims[1])], t.values, tile)


def untiled(m: Tiled) -> Tensor:
    """The tensor of a matrix of tiles."""
    df = m.cells().toDF("a0", "a1", *m.values)  # both axes may go by one name
    return Tensor(df, (m.rows[0][1], m.cols[0][1]), "complex" if m.kind == "complex" else "real")


def block_product(left: DataFrame, right: DataFrame, batch: Sequence[Axis], rows: Sequence[Axis], cols: Sequence[Axis], inner: Sequence[Axis], values: Sequence[str], tile: int = TILE) -> DataFrame:
    """Sum over ``inner`` of ``left`` times ``right``, both with the columns ``values`` and axes by name."""
    return Tiled.of(left, batch, rows, inner, values, tile).times(Tiled.of(right, batch, inner, cols, values, tile)).cells()


def block_matmul(a: Tensor, b: Tensor, tile: int = TILE) -> Tensor:
    """``ij,jk->ik`` by tiles, real or complex, of sizes known or not."""
    a.need_rank(2)
    b.need_rank(2)
    if None not in (a.dims[1], b.dims[0]) and a.dims[1] != b.dims[0]:
        raise DimensionMismatch(f"{a.dims[1]} and {b.dims[0]}")
    if a.is_complex() or b.is_complex():
        a, b = a.to_complex(), b.to_complex()
    return untiled(tiled(a, tile).times(tiled(b, tile)))


def gram_rows(df: DataFrame, key: str, array: str, queries: DataFrame | None = None, tile: int = TILE) -> Tensor:
    """``ik,jk->ij`` of an array column of ``queries`` (by default ``df`` too) with that of ``df``, by blocks of ``16 * tile`` by ``4 * tile`` rows.

    Keys are numbers, dense or not; a pair of rows without a common place has no cell.
    """

    from tensorloom.operators.rows import row_product

    def cells(rows: DataFrame, name: str) -> DataFrame:
        found = rows.select(F.col(key).cast("long").alias(name), F.posexplode(array).alias("k", "v"))
        kind = dict(found.dtypes)["v"]
        return found.select(name, F.col("k").cast("long").alias("k"), F.coalesce("v", F.lit(0).cast(kind)).alias("v"))

    queries = df if queries is None else queries
    n = [rows.count() for rows in (queries, df)]
    return Tensor(row_product(cells(queries, "a0"), cells(df, "a1"), [], ["a0"], ["a1"], ["k"], ["v"], n, (16 * tile, 4 * tile)), (None, None))


def by_blocks(sizes: Sequence[Sequence[int | None]], cells: Sequence[float | None]) -> bool:
    """Whether a product pays by tiles: the axes ``batch, rows, cols, inner`` have known or
    measured sizes and make up enough pairs, and both operands are dense."""
    batch, rows, cols, inner = sizes
    if not rows or not cols or not inner or None in (*batch, *rows, *cols, *inner, *cells):
        return False
    grids = prod((*batch, *rows, *inner)), prod((*batch, *inner, *cols))
    return prod((*batch, *rows, *cols, *inner)) >= BLOCKS_FROM and all(c > DENSE * g for c, g in zip(cells, grids, strict=True))


def placed(form: Tiled | None, make: Callable[[], DataFrame], names: dict[Hashable, str], batch: Sequence[Axis], rows: Sequence[Axis], cols: Sequence[Axis], values: Sequence[str]) -> Tiled:
    """An operand as tiles of ``rows`` by ``cols``: the form it already has, turned if need be, or one built from its cells."""
    if form is not None and form.batch == list(batch):
        if (form.rows, form.cols) == (list(rows), list(cols)):
            return form
        if (form.cols, form.rows) == (list(rows), list(cols)):
            return form.transposed()
    return Tiled.of(make(), batch, rows, cols, values)


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """``ij,jk->ik``, by tiles if that pays (see ``by_blocks``)."""
    from tensorloom.operators.einsum import einsum

    return einsum("ij,jk->ik", a, b)
