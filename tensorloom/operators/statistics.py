"""What a tensor's cells look like, in one pass: their number, and by axis the distinct
coordinates (a HyperLogLog sketch) and the most frequent ones (a frequent-items sketch).
All of it is one row of bounded size, whatever the table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import functions as F

from tensorloom.tensor import Tensor

#: Frequent coordinates that are told for an axis, and those that the sketch tracks for it.
TOP, TRACKED = 1024, 16384


class Statistics(NamedTuple):
    """``distinct`` and ``frequent`` (coordinate -> about how many cells) by axis."""

    rows: int
    distinct: tuple[int, ...]
    frequent: tuple[dict[int, int], ...]

    def picked(self, places: list[int]) -> Statistics:
        """Of some axes, in the order of ``places``."""
        return Statistics(self.rows, tuple(self.distinct[k] for k in places), tuple(self.frequent[k] for k in places))


def measure(t: Tensor) -> Statistics:
    """One aggregate over all cells; a tensor that was measured before is not read again."""
    if t.stats is not None:
        return t.stats
    sketches = [c for a in t.axes for c in (F.hll_sketch_estimate(F.hll_sketch_agg(a)).alias(f"d_{a}"), F.expr(f"approx_top_k({a}, {TOP}, {TRACKED})").alias(f"f_{a}"))]
    row = t.df.agg(F.count(F.lit(1)).alias("n"), *sketches).first()
    return Statistics(row["n"], tuple(row[f"d_{a}"] or 0 for a in t.axes), tuple({x["item"]: x["count"] for x in row[f"f_{a}"] or ()} for a in t.axes))
