"""Array files: headers, row ranges, arrays side by side, the sink."""

import glob
import io as bytes_io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from biaslens.sources import npy

DTYPES = ["<f4", ">f8", "<i4", ">i8", "|u1", "<u2", "|b1", "<f2", "|i1"]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(DTYPES), st.integers(1, 40), st.sampled_from([None, 0, 1, 3]), st.booleans(), st.data())
def test_cells_of_any_range(dtype, rows, width, by_column, data):
    x = (np.arange(rows * (1 if width is None else width)) % 100).astype(dtype).reshape((rows,) if width is None else (rows, width))
    held = bytes_io.BytesIO()
    np.lib.format.write_array(held, np.asfortranarray(x) if by_column else x,
                              version=data.draw(st.sampled_from([(1, 0), (2, 0), (3, 0)])))
    held.seek(0)
    part = npy.part_of("x.npy", held)
    lo = data.draw(st.integers(0, rows - 1))
    hi = data.draw(st.integers(lo, rows))
    assert np.array_equal(part.cells(held, lo, hi), x[lo:hi].reshape(hi - lo, -1) if hi > lo else x[lo:hi].reshape(0, 1 if width is None else width))


def rows_of(df):
    return sorted(df.collect(), key=lambda r: r["position"])


def test_arrays_side_by_side(spark, tmp_path):
    """One file against a folder of uneven parts, in ranges that cut both."""
    rng = np.random.default_rng(1)
    x, ids = rng.standard_normal((997, 5)).astype("<f4"), rng.permutation(997)
    np.save(tmp_path / "x.npy", np.asfortranarray(x))
    (tmp_path / "ids").mkdir()
    for k, (a, b) in enumerate([(0, 1), (1, 400), (400, 400), (400, 997)]):
        np.save(tmp_path / "ids" / f"part-{k}.npy", ids[a:b])
    back = npy.read_arrays(spark, {"id": f"{tmp_path}/ids", "x": f"{tmp_path}/x.npy"}, range_bytes=28 * 100)
    assert back.rdd.getNumPartitions() == 10
    assert back.schema.simpleString() == "struct<position:bigint,id:bigint,x:array<float>>"
    assert "Exchange" not in back._jdf.queryExecution().toString()
    got = rows_of(back)
    assert [r["position"] for r in got] == list(range(997))
    assert np.array_equal([r["id"] for r in got], ids) and np.array_equal(np.array([r["x"] for r in got], "f4"), x)


@pytest.mark.parametrize("rows_per_part", [1, 7, 1000])
def test_round_trip(spark, tmp_path, rows_per_part):
    df = spark.range(300, numPartitions=5).orderBy(F.rand(3)).select(
        F.col("id").alias("position"), F.array(F.col("id") * 0.5, F.sqrt("id"), F.lit(float("nan"))).alias("v"))
    n = 20 if rows_per_part == 1 else 300
    path = f"{tmp_path}/x"
    assert npy.write_array(df.where(F.col("position") < n), path, "v", rows_per_part=rows_per_part) == n
    files = sorted(glob.glob(f"{path}/*"))
    assert len(files) == -(-n // rows_per_part)
    want = np.stack([np.arange(n) * 0.5, np.sqrt(np.arange(n)), np.full(n, np.nan)], axis=1)
    assert np.array_equal(np.concatenate([np.load(f) for f in files]), want, equal_nan=True)
    got = rows_of(npy.read_arrays(spark, {"v": path}, range_bytes=24 * 50))
    assert np.array_equal(np.array([r["v"] for r in got]), want, equal_nan=True)
    with pytest.raises(FileExistsError):
        npy.write_array(df, path, "v")


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "position long, v array<int>")
    assert npy.write_array(empty, f"{tmp_path}/x", "v") == 0
    assert npy.read_arrays(spark, {"v": f"{tmp_path}/x"}).count() == 0


@pytest.mark.parametrize("rows", [
    [(0, [1]), (2, [1])],                   # a gap
    [(0, [1]), (1, [1]), (1, [1]), (3, [1])],   # a repeat
    [(0, [1]), (1, None)], [(0, [1]), (1, [None])], [(0, [1]), (None, [1])],
    [(0, [1]), (1, [1, 2])],
])
def test_rows_that_no_array_has(spark, tmp_path, rows):
    with pytest.raises(Exception, match="nulls|gap or a repeat"):
        npy.write_array(spark.createDataFrame(rows, "position long, v array<int>"), f"{tmp_path}/x", "v")
    assert not glob.glob(f"{tmp_path}/x/*.npy")


def test_files_that_cannot_be_read(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(10))
    np.save(tmp_path / "b.npy", np.arange(11))
    with pytest.raises(Exception, match="different length"):
        npy.read_arrays(spark, {"a": f"{tmp_path}/a.npy", "b": f"{tmp_path}/b.npy"}).collect()
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="ends before"):
        npy.read_arrays(spark, {"a": f"{tmp_path}/short.npy"}).collect()
    (tmp_path / "text.npy").write_bytes(b"plain text, no array")
    np.save(tmp_path / "words.npy", np.array(["a", "b"]))
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    for name, why in (("text", "not an array"), ("words", "no column"), ("cube", "dimensions"), ("gone", "gone")):
        with pytest.raises(Exception, match=why):
            npy.read_arrays(spark, {"a": f"{tmp_path}/{name}.npy"}).collect()
