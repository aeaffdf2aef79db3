"""Neighbouring inner blocks are summed in one task; left tiles that memory does not take are read from a file."""

import numpy as np

from tensorloom import Tensor
from tensorloom.operators import tiers
from tensorloom.operators.tiers import Kept, tiled, untiled
from tensorloom.sources.tensors import from_numpy, to_numpy


def test_neighbours_are_summed_before_they_are_sent(spark, monkeypatch):
    """Of 16 inner blocks in runs of 8, a tile of the result gets two sums, not 16 products."""
    monkeypatch.setattr(tiers, "RUN", 8)
    monkeypatch.setattr(tiers, "KEPT", 100)
    a = np.random.default_rng(9).integers(1, 5, (8, 64)).astype(float)
    t = Tensor(from_numpy(spark, a).df, (None, None))
    product = tiled(t, 4).times(tiled(t, 4).transposed())
    np.testing.assert_array_equal(to_numpy(Tensor(untiled(product).df, (8, 8))), a @ a.T)
    assert sent(product) <= 2 * 2 * 2


def sent(product):
    """Rows of products that go to be summed."""
    plan = product.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    rows = product.df.sparkSession.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(product.df.sparkSession._jsparkSession, lowest(product.df._jdf.queryExecution().optimizedPlan()))
    return rows.count()


def lowest(plan):
    """The plan of ``multiply``."""
    while "multiply" not in plan.simpleString(200):
        plan = plan.children().head()
    return plan


def test_rows_kept_in_a_file():
    kept, rows = Kept(20), [(k, b"x" * k, b"y" * 9) for k in range(5)]
    for r in rows[:4]:
        kept.add(r)
    assert list(kept) == rows[:4] == list(kept)
    kept.add(rows[4])
    assert list(kept) == rows and kept.file is not None
    kept.clear()
    assert list(kept) == []
