"""Virtual axes, heavy coordinates, update logs, buckets, and operands scanned once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom import MAX_PLUS, Tensor, catalog, einsum
from tensorloom.errors import InvalidAxis, RankMismatch, ShapeMismatch
from tensorloom.operators import contract
from tensorloom.operators.updates import UpdateLog, set_many
from tensorloom.operators.virtual import Repeated, constant, identity
from tensorloom.sources.bucketed import write_bucketed
from tensorloom.sources.tensors import from_numpy, to_numpy

V, M = np.array([1.0, 2.0, 3.0]), np.arange(12.0).reshape(3, 4)


def plan(t):
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def joins(t):
    return len(re.findall(r"\bJoin\b", plan(t)))


def test_repeats_need_no_cross_join(spark):
    v, m = from_numpy(spark, V), from_numpy(spark, M)
    r = einsum("i->ij", v, sizes={"j": 3})
    assert isinstance(r, Repeated) and r.dims == (3, 3) and r.cells == 9
    np.testing.assert_array_equal(to_numpy(r), np.repeat(V[:, None], 3, axis=1))
    found = einsum("ij,jk->ik", r, m)
    np.testing.assert_array_equal(to_numpy(found), np.repeat(V[:, None], 3, axis=1) @ M)
    assert "Range (0, 3" not in plan(found) and joins(found) == 1  # of row sums and v alone
    np.testing.assert_array_equal(to_numpy(einsum("ij->i", r)), 3 * V)
    np.testing.assert_array_equal(to_numpy(einsum("ij->ji", r)), np.repeat(V[None], 3, axis=0))
    np.testing.assert_array_equal(to_numpy(einsum("ij,j->j", r, v)), V.sum() * V)
    np.testing.assert_array_equal(to_numpy(r.permute((1, 0)).conj()), np.repeat(V[None], 3, axis=0))
    assert joins(einsum("ij->i", r)) == 0


def test_deltas_give_labels_one_name(spark):
    m = from_numpy(spark, M)
    eye = identity(spark, 4)
    np.testing.assert_array_equal(to_numpy(eye), np.eye(4))
    np.testing.assert_array_equal(to_numpy(einsum("ij,jk->ik", m, eye)), M)
    assert "Range (0, 4" not in plan(einsum("ij,jk->ik", m, eye))  # only the one row of the value is joined
    np.testing.assert_array_equal(to_numpy(einsum("ij,ij->ij", einsum("i->ii", from_numpy(spark, V)), from_numpy(spark, M[:, :3]))), np.diag(V) * M[:, :3])
    np.testing.assert_array_equal(to_numpy(einsum("ii->", eye)), 4)
    np.testing.assert_array_equal(to_numpy(einsum("ij->", einsum("i->ii", from_numpy(spark, V)))), V.sum())
    np.testing.assert_array_equal(to_numpy(einsum("ij,jk->ik", identity(spark, 3), einsum("i->ii", from_numpy(spark, V)))), np.diag(V))
    np.testing.assert_array_equal(to_numpy(einsum("(ij,jk),kl->il", m, eye, from_numpy(spark, M.T))), M @ M.T)


def test_constants(spark):
    c = constant(spark, (3, 4), 2.0)
    np.testing.assert_array_equal(to_numpy(c), np.full((3, 4), 2.0))
    np.testing.assert_array_equal(to_numpy(constant(spark, (2,), 1 + 2j)), np.full(2, 1 + 2j))
    np.testing.assert_array_equal(to_numpy(einsum("ij,ij->i", c, from_numpy(spark, M))), 2 * M.sum(axis=1))
    np.testing.assert_array_equal(to_numpy(einsum("ij,kj->ik", c, c)), np.full((3, 3), 16.0))
    np.testing.assert_array_equal(to_numpy(einsum("ij,jk->", c, constant(spark, (4, 5), 1.0))), 2 * 3 * 4 * 5)
    whole = einsum("ij->i", einsum("i->ij", from_numpy(spark, np.array([1, 2])), sizes={"j": 5}))
    assert sorted(r.v for r in whole.df.collect()) == [5, 10] and dict(whole.df.dtypes)["v"] == "bigint"
    assert einsum("ij->i", einsum("i->ij", from_numpy(spark, V), sizes={"j": 0})).df.count() == 0


def test_virtual_sizes_bound_other_operands(spark):
    open_ = Tensor(from_numpy(spark, M).df, (None, None))
    found = einsum("ij,j->i", open_, constant(spark, (2,), 1.0))
    np.testing.assert_array_equal(to_numpy(Tensor(found.df, (3,))), M[:, :2].sum(axis=1))


def test_virtual_axes_under_a_semiring(spark):
    r = einsum("i->ij", from_numpy(spark, V), sizes={"j": 3})
    np.testing.assert_array_equal(to_numpy(einsum("ij,jk->ik", r, from_numpy(spark, M), semiring=MAX_PLUS)), V[:, None] + M.max(axis=0))


def test_broadcast_is_virtual(spark):
    t = from_numpy(spark, M[:1]).broadcast((5, 4))
    assert isinstance(t, Repeated)
    np.testing.assert_array_equal(to_numpy(t), np.repeat(M[:1], 5, axis=0))
    np.testing.assert_array_equal(to_numpy(einsum("ij->j", t)), 5 * M[0])
    with pytest.raises(ShapeMismatch):
        from_numpy(spark, M).broadcast((3, 5))


def test_updates(spark):
    rows = [(0, 0, 10.0, 1), (0, 0, 20.0, 3), (0, 0, 15.0, 2), (2, 3, -1.0, 1), (1, 1, None, 1), (0, 9, 5.0, 1), (None, 1, 5.0, 1), (1, 2, 7.0, 1), (1, 2, 8.0, 1)]
    updates = spark.createDataFrame(rows, "a0 long, a1 long, v double, version long")
    want = M.copy()
    want[0, 0], want[2, 3], want[1, 1], want[1, 2] = 20, -1, 0, 8
    found = set_many(from_numpy(spark, M), updates)
    np.testing.assert_array_equal(to_numpy(found), want)
    assert joins(found) == 1 and found.df.count() == 11  # one cell is gone
    np.testing.assert_array_equal(to_numpy(set_many(from_numpy(spark, M), updates.limit(0))), M)
    z = set_many(from_numpy(spark, M[:1, :2] + 1j).conj(), spark.createDataFrame([(0, 1, 5.0, 6.0, 1)], "a0 long, a1 long, re double, im double, version long"))
    np.testing.assert_array_equal(to_numpy(z), [[0 - 1j, 5 + 6j]])
    assert to_numpy(set_many(from_numpy(spark, np.array(3.0)), spark.createDataFrame([(4.0, 1), (9.0, 2)], "v double, version long"))) == 9
    with pytest.raises(RankMismatch):
        set_many(from_numpy(spark, V), updates.drop("a0"))


def test_update_log(spark, tmp_path):
    log = UpdateLog(from_numpy(spark, M), str(tmp_path))
    put = lambda *rows: log.append(spark.createDataFrame(list(rows), "a0 long, a1 long, v double, version long"))
    np.testing.assert_array_equal(to_numpy(log.read()), M)
    put((0, 0, 5.0, 9), (1, 1, 6.0, 1))
    put((0, 0, 7.0, 2))
    want = M.copy()
    want[0, 0], want[1, 1] = 5, 6
    np.testing.assert_array_equal(to_numpy(log.read()), want)
    log.compact()
    assert not log.batches
    put((1, 1, 1.0, 10))
    want[1, 1] = 1
    np.testing.assert_array_equal(to_numpy(log.read()), want)


def test_buckets_join_without_an_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (write_bucketed(from_numpy(spark, x), f"bucketed_{n}", [k], 4) for n, (x, k) in enumerate(((M, 1), (M.T, 0))))
        found = einsum("ij,jk->ik", a, b)
        physical = found.df._jdf.queryExecution().executedPlan().toString()
        below = physical[physical.index("Join") :]
        assert "Exchange" not in below and physical.count("Exchange") == 1  # for the sum alone
        np.testing.assert_array_equal(to_numpy(Tensor(found.df, (3, 3))), M @ M.T)
        batch = einsum("ij,jk->jik", a, b)
        assert "Exchange" not in batch.df._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(InvalidAxis):
            write_bucketed(a, "bucketed_x", [2], 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in range(2):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{n}")


@pytest.mark.parametrize("turn", [False, True])
def test_a_label_in_half_of_the_rows_is_dealt_out(spark, monkeypatch, turn):
    monkeypatch.setattr(contract, "HOT_ROWS", 100)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 8000
        left = Tensor(spark.range(n).select(F.col("id").alias("a0"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("a1"), F.lit(1.0).alias("v")), (None, None))
        right = Tensor(spark.range(n).select(F.col("id").alias("a0"), (F.col("id") % 3).alias("a1"), F.lit(2.0).alias("v")), (None, None))
        names = contract.label_columns("ijk")
        a, b = contract.labelled(left.measured(), "ij", names), contract.labelled(right.measured(), "jk", names)
        if turn:
            a, b = b, a
        x, y, salt = contract._salted(a, b, a.df, b.df, ["j"])
        assert salt
        keys = [names["j"], *salt]
        large = y if turn else x
        sizes = sorted(r["count"] for r in large.repartition(16, *keys).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
        found = einsum("ij,jk->k", left.measured(), right.measured())
        want = {0: 0.0, 1: 0.0, 2: 0.0}
        for i in range(n):
            j = 7 if i % 2 == 0 else i
            want[j % 3] += 2.0
        assert {r.a0: r.v for r in found.df.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name", ["zip4", "matrix_chain", "star"])
def test_shared_operands_are_scanned_once(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_", final)) == 1
