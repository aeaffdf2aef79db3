"""Arrays in files: chunks written and read by tasks, strided views, and recovery."""

import json
import os

import numpy as np
import pytest

from tensorloom import Tensor
from tensorloom.errors import OffsetOverflow, ScalarConversion, ShapeMismatch, StrideLengthMismatch
from tensorloom.sources.files import MANIFEST, ChunkWriter, StoredArray, from_file, write_chunks
from tensorloom.sources.tensors import from_numpy, to_numpy

A = np.arange(60.0).reshape(10, 6)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrays") / "a")
    write_chunks(from_numpy(spark, A), path, rows=3)
    return path


def test_round_trip(spark, stored):
    with open(f"{stored}/{MANIFEST}") as f:
        found = json.load(f)
    assert found["dims"] == [10, 6] and sorted(map(int, found["chunks"])) == [0, 1, 2, 3]
    assert np.load(f"{stored}/{found['chunks']['3']}").shape == (1, 6)
    np.testing.assert_array_equal(to_numpy(from_file(spark, stored)), A)
    many = from_file(spark, f"file://{stored}", cells=7)
    assert many.df.rdd.getNumPartitions() == 9
    np.testing.assert_array_equal(to_numpy(many), A)


def test_views(spark, stored):
    flat = A.reshape(-1)
    view = lambda *a, **k: to_numpy(from_file(spark, stored, *a, **k))
    np.testing.assert_array_equal(view((10, 3), (-6, 2), 54), A[::-1, ::2])
    np.testing.assert_array_equal(view((5, 3, 4)), flat.reshape(5, 3, 4))
    np.testing.assert_array_equal(view((6, 10), (1, 6)), A.T)
    np.testing.assert_array_equal(view((4, 10), (0, 6), 2, checked=False), np.tile(A[:, 2], (4, 1)))
    np.testing.assert_array_equal(view((), (), 7), 7)
    assert from_file(spark, stored, (0, 3)).df.count() == 0
    for error, bad in ((OffsetOverflow, ((10, 7), (6, 1), 1)), (OffsetOverflow, ((3,), (-6,), 0)), (StrideLengthMismatch, ((3,), (6, 1)))):
        with pytest.raises(error):
            from_file(spark, stored, *bad)


def test_kinds_absent_cells_and_single_files(spark, tmp_path):
    z = A + 1j * A[::-1]
    write_chunks(Tensor(from_numpy(spark, z).conj().resolved().df.where("a0 <> 4"), z.shape, "complex"), str(tmp_path / "z"), rows=4)
    want = z.conj()
    want[4] = 0
    np.testing.assert_array_equal(to_numpy(from_file(spark, str(tmp_path / "z"))), want)
    write_chunks(from_numpy(spark, A.astype(int)), str(tmp_path / "i"))
    assert dict(from_file(spark, str(tmp_path / "i")).df.dtypes)["v"] == "bigint"
    write_chunks(Tensor(from_numpy(spark, A).df.where("a0 < 3"), A.shape), str(tmp_path / "part"), rows=3)
    assert to_numpy(from_file(spark, str(tmp_path / "part"))).sum() == A[:3].sum()
    for name, array in (("c", A), ("f", np.asfortranarray(A)), ("s", np.array(5.0))):
        np.save(tmp_path / f"{name}.npy", array)
        np.testing.assert_array_equal(to_numpy(from_file(spark, str(tmp_path / f"{name}.npy"))), array)
    np.save(tmp_path / "text.npy", np.array(["a"]))
    with pytest.raises(ScalarConversion):
        from_file(spark, str(tmp_path / "text.npy"))
    with pytest.raises(ShapeMismatch):
        write_chunks(Tensor(from_numpy(spark, A).df, (None, 6)), str(tmp_path / "open"))


def test_a_task_run_twice_leaves_one_chunk(spark, tmp_path):
    import pyarrow as pa

    writer = ChunkWriter({"path": str(tmp_path), "dims": "[2, 2]", "rows": "2", "dtype": "float64"})
    rows = pa.RecordBatch.from_pydict({"block": [0, 0], "a0": [0, 1], "a1": [0, 1], "v": [1.0, 2.0]})
    writer.write(iter([rows]))  # its result was lost
    writer.commit([writer.write(iter([rows])), None])
    array = StoredArray(str(tmp_path))
    assert len(array.chunks) == 1 and array.take(np.arange(4)).tolist() == [1, 0, 0, 2]
    lost = writer.write(iter([rows]))
    writer.abort([lost])
    assert not any(os.path.exists(tmp_path / n) for n in lost.chunks.values())
