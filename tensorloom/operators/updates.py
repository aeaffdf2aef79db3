"""Many cell updates at once: a log of versions, of which the latest wins.

Updates are rows of coordinates, values and a version. They are appended to a log and never
changed; a tensor is read as its cells with the latest update of each coordinate put over
them, by one grouping of the log and one join. Compaction writes what is read as new cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.errors import RankMismatch
from tensorloom.tensor import Tensor

VERSION = "version"


def latest(updates: DataFrame, axes: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of each coordinate the values of its highest version, of equal versions the largest; a null value removes the cell.

    The fold keeps one row a coordinate and task, so a coordinate that is updated all the time costs no more than others.
    """
    best = F.max(F.struct(F.col(VERSION), *[F.col(v) for v in values]))
    found = updates.where(" and ".join(f"{a} is not null" for a in axes) or "true")
    grouped = found.groupBy(*axes).agg(best.alias("x")) if axes else found.agg(best.alias("x")).where("x is not null")
    return grouped.select(*axes, F.lit(True).alias("set_"), *[F.col(f"x.{v}").alias(f"new_{v}") for v in values])


def set_many(t: Tensor, updates: DataFrame) -> Tensor:
    """``t`` with ``updates`` (columns ``a0, a1, ...``, the values and ``version``) carried out by one join.

    Coordinates that are null or outside of known sizes are left out; a null value makes a
    cell absent. Without updates nothing changes.
    """
    here = t.resolved()
    missing = {*here.axes, *here.values, VERSION} - set(updates.columns)
    if missing:
        raise RankMismatch(f"updates lack {sorted(missing)}")
    rows = updates.select(*[F.col(a).cast("long").alias(a) for a in here.axes], *here.values, VERSION)
    for a, n in zip(here.axes, here.dims, strict=True):
        rows = rows.where(F.col(a) >= 0 if n is None else F.col(a).between(0, n - 1))
    new = latest(rows, here.axes, here.values)
    both = here.df.join(new, here.axes, "full") if here.rank else here.df.join(new, F.lit(True), "left")
    columns = [F.when(F.col("set_"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in here.values]
    df = both.select(*here.axes, *columns).where(" and ".join(f"{v} is not null" for v in here.values))
    return Tensor(df, here.dims, here.dtype)


class UpdateLog:
    """A tensor in a folder: generations of cells, and the updates since the last one."""

    def __init__(self, t: Tensor, path: str) -> None:
        self.spark, self.dims, self.dtype, self.path = t.df.sparkSession, t.dims, t.dtype, path.rstrip("/")
        self.axes, self.values = t.axes, t.values
        self.cells = f"{self.path}/cells-{uuid.uuid4().hex}"
        t.resolved().df.write.parquet(self.cells)
        self.batches: list[str] = []

    def append(self, updates: DataFrame) -> None:
        """One more batch; batches may come in any order, as their versions tell which is later."""
        path = f"{self.path}/updates-{uuid.uuid4().hex}"
        updates.select(*[F.col(a).cast("long").alias(a) for a in self.axes], *self.values, VERSION).write.parquet(path)
        self.batches.append(path)

    def read(self) -> Tensor:
        cells = Tensor(self.spark.read.parquet(self.cells), self.dims, self.dtype)
        return set_many(cells, self.spark.read.parquet(*self.batches)) if self.batches else cells

    def compact(self) -> None:
        """Write the present cells as a new generation and start an empty log."""
        path = f"{self.path}/cells-{uuid.uuid4().hex}"
        self.read().df.write.parquet(path)
        self.cells, self.batches = path, []
