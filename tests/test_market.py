"""Matrices as texts of coordinates."""

import numpy as np
import pytest

from eigenfold.sources import matrices as src


def entries(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_of_several_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 50, 300), rng.integers(0, 70, 300), rng.standard_normal(300))]
    df = spark.createDataFrame(rows, "i long, j long, v double").repartition(5)
    src.write_matrix_market(df, 50, 70, str(tmp_path / "m"))
    back, n, m = src.read_matrix_market(spark, str(tmp_path / "m"))
    assert (n, m) == (50, 70) and entries(back) == sorted(rows)
    cplx = spark.createDataFrame([(0, 1, 1.5, -2.0)], "i long, j long, v double, vi double")
    src.write_matrix_market(cplx, 2, 2, str(tmp_path / "c"))
    assert entries(src.read_matrix_market(spark, str(tmp_path / "c"))[0]) == [(0, 1, 1.5, -2.0)]


def test_large_file_in_splits(spark, tmp_path):
    path = tmp_path / "big.mtx"
    path.write_text("%%MatrixMarket matrix coordinate integer general\n% a comment\n\n3000 3000 3000\n" + "".join(f"{k} {3001 - k}   {k}\n" for k in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df, n, m = src.read_matrix_market(spark, str(path))
        assert df.rdd.getNumPartitions() > 3 and entries(df) == sorted((k - 1, 3000 - k, float(k)) for k in range(1, 3001))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("kind,sign", [("symmetric", 1.0), ("skew-symmetric", -1.0)])
def test_other_half(spark, tmp_path, kind, sign):
    path = tmp_path / "s.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate real {kind}\n3 3 2\n2 1 4.0\n3 3 1.0\n")
    assert entries(src.read_matrix_market(spark, str(path))[0]) == [(0, 1, sign * 4.0), (1, 0, 4.0), (2, 2, 1.0)]
    path.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 4.0 3.0\n")
    assert entries(src.read_matrix_market(spark, str(path))[0]) == [(0, 1, 4.0, -3.0), (1, 0, 4.0, 3.0)]
    path.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n")
    assert entries(src.read_matrix_market(spark, str(path))[0]) == [(1, 0, 1.0)]


@pytest.mark.parametrize(
    "text",
    ["1 1 1\n1 1 1.0\n", "%%MatrixMarket matrix array real general\n1 1\n1.0\n", "%%MatrixMarket matrix coordinate real diagonal\n1 1 1\n1 1 1.0\n", "%%MatrixMarket matrix coordinate real general\n", "%%MatrixMarket matrix coordinate real general\n2 x 1\n1 1 1.0\n",
     "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1.0\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1.0\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 one\n"],
)
def test_malformed_texts_are_refused(spark, tmp_path, text):
    path = tmp_path / "bad.mtx"
    path.write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        src.read_matrix_market(spark, str(path))[0].collect()
