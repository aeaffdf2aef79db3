"""Sums of doubles that do not depend on any order: exact, and rounded once.

A double is cut into three integers at fixed binary places, 32 bits apart, below a bin of
its exponent. Integers of a bin are summed as decimals, which is exact and the same in any
order, with partial sums before the one exchange; a group has at most 66 bins. What comes
out is the exact sum, rounded to the nearest double, ties to even, as ``math.fsum`` does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions.monoids import Monoid
from tensorloom.tensor import Tensor

#: In place of ``SUM`` in reductions.
EXACT_SUM = Monoid("exact_sum", F.sum, 0.0)

#: Bits between the places where values are cut, and the bins of what is not finite.
BITS, PLUS, MINUS, NAN = 32, 1000, 1001, 1002


def _pieces(value: Column) -> list[Column]:
    """``bin`` and three integers: value = (high + mid / 2**32 + low / 2**64) * 2**(32 bin)."""
    size = F.abs(value)
    bin_ = F.when(size == 0, F.lit(0)).otherwise(F.floor(F.log2(size) / BITS)).cast("int")
    half = F.pow(F.lit(2.0), bin_ * (-BITS // 2))  # twice, as the whole power may have no double
    scaled = value * half * half
    odd = F.isnan(value) | (size == float("inf"))
    named = F.when(F.isnan(value), NAN).when(value == float("inf"), PLUS).when(value == float("-inf"), MINUS).otherwise(bin_)
    return [named.cast("int").alias("bin"), F.when(odd, F.lit(0.0)).otherwise(scaled).alias("y")]


def rounded(bins: Sequence[int], sums: Sequence[Sequence[int]]) -> float:
    """The double nearest to the sum of all bins' integers."""
    special = {b for b in bins if b >= PLUS}
    if special:
        return math.nan if NAN in special or len(special) > 1 else math.inf if PLUS in special else -math.inf
    low = min(bins) - 2
    total = sum((int(h) << 2 * BITS) + (int(m) << BITS) + int(x) << BITS * (b - low - 2) for b, (h, m, x) in zip(bins, sums, strict=True))
    try:
        return total / (1 << -BITS * low) if low < 0 else float(total << BITS * low)
    except OverflowError:
        return math.copysign(math.inf, total)


def exact_total(t: Tensor, values: Sequence[Column], left: Sequence[int], dims: Sequence[int | None]) -> Tensor:
    """Exact sums of one or two value columns by the axes ``left``."""
    keys, names = [f"a{k}" for k in range(len(left))], ["re", "im"] if len(values) == 2 else ["v"]
    rows = t.df.select(*[F.col(f"a{o}").alias(f"a{k}") for k, o in enumerate(left)], *[v.cast("double").alias(f"in{k}") for k, v in enumerate(values)])
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"in{k}").alias("x")) for k in range(len(values))]))
    rows = rows.select(*keys, parts.alias("e")).select(*keys, F.col("e.part").alias("part"), F.col("e.x").alias("x")).where("x is not null")
    rows = rows.select(*keys, "part", *_pieces(F.col("x")))
    whole = lambda c: c.cast("long")  # noqa: E731  towards zero
    rows = rows.withColumn("h", whole(F.col("y"))).withColumn("y", (F.col("y") - F.col("h")) * float(1 << BITS))
    rows = rows.withColumn("m", whole(F.col("y"))).withColumn("x", whole((F.col("y") - F.col("m")) * float(1 << BITS)))
    sums = rows.groupBy(*keys, "part", "bin").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in "hmx"])
    grouped = sums.groupBy(*keys).agg(F.collect_list(F.struct("part", "bin", "h", "m", "x")).alias("bins"))  # at most 66 a value

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for bins in b.column(b.num_columns - 1).to_pylist():
                for k, column in enumerate(out):
                    own = [x for x in bins if x["part"] == k]
                    column.append(rounded([x["bin"] for x in own], [(x["h"], x["m"], x["x"]) for x in own]) if own else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.float64()) for c in out]], [*keys, *names])

    df = grouped.mapInArrow(finish, ", ".join([f"{k} long" for k in keys] + [f"{n} double" for n in names]))
    return Tensor(df, dims, "complex" if len(names) == 2 else "real", cells=None if keys else 1.0)
