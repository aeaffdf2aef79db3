"""Tensors stored by buckets of an axis, so that contractions over it need no exchange.

Cells go to buckets by the hash of one axis or several and are sorted there. Two tensors with
as many buckets on the axes that a contraction joins meet bucket by bucket; what is grouped by
these axes, too, stays where it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from tensorloom.errors import InvalidAxis
from tensorloom.tensor import Tensor, axis


def write_bucketed(t: Tensor, name: str, axes: Sequence[int], buckets: int, path: str | None = None) -> Tensor:
    """Store ``t`` as the table ``name``, by ``axes``; one exchange, paid once for all contractions over them.

    Files go to ``path``, or else to the session's warehouse.
    """
    if not axes or any(not 0 <= k < t.rank for k in axes):
        raise InvalidAxis(f"axes {list(axes)} of {t.rank}")
    by = [axis(k) for k in axes]
    # dealt out as buckets are, so that each is one file
    rows = t.resolved().df.repartition(buckets, *by)
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return read_bucketed(t.df.sparkSession, name, t.dims)


def read_bucketed(spark: SparkSession, name: str, dims: Sequence[int | None]) -> Tensor:
    df = spark.table(name)
    return Tensor(df, dims, "complex" if "re" in df.columns else "real")
