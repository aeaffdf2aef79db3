"""Contraction of a stream of cells with a static tensor.

Each event is a cell of the stream's operand; cells of equal coordinates add up. The
sum is linear, so it can be kept as running state: a stream-static join and one
streaming aggregation, with a watermark where the caller groups by event time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.tensor import Tensor


def stream_contract(stream: DataFrame, keys: Sequence[str], value: str, static: Tensor, static_labels: str, out: str) -> DataFrame:
    """Running ``keys, labels -> out`` sums; ``keys`` are stream columns named by one-letter labels.

    Write it in ``update`` or ``complete`` mode.
    """
    right = static.resolved().df.select(*[F.col(a).alias(x) for a, x in zip(static.axes, static_labels, strict=True)], F.col("v").alias("_static"))
    left = stream.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(value).alias("_stream"))
    shared = [x for x in static_labels if x in keys]
    return left.join(right, shared).groupBy(*out).agg(F.sum(F.col("_stream") * F.col("_static")).alias("value"))
