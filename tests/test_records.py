"""Files that all tasks write at once: the same bytes whatever the parts, read back by ranges, refusals."""

import os

import numpy as np
import pytest

from stoa.sources import clouds, las, records


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c), int(r)) for (a, b, c), r in zip(rng.normal(size=(500, 3)) * 9, rng.integers(0, 65_536, 500), strict=True)]
    return spark.createDataFrame(rows, "x double, y double, z double, red int").selectExpr("*", "1 as green", "300 as blue", "7 as intensity", "red / 256.0 as r", "cast(1 as double) as g", "cast(2 as double) as b")


@pytest.mark.parametrize("write", [records.write_ply, records.write_las, records.write_npy])
def test_parts_make_the_same_bytes(cloud, tmp_path, write):
    made = []
    for parts in (1, 8):
        path = str(tmp_path / f"{parts}")
        assert write(cloud.repartitionByRange(parts, "x").sortWithinPartitions("x"), path) == 500
        with open(path, "rb") as f:
            made.append(f.read())
    assert made[0] == made[1] and len(os.listdir(tmp_path)) == 2
    assert write(cloud.limit(0), str(tmp_path / "none")) == 0


def test_clouds_read_back(spark, cloud, tmp_path):
    clouds.register(spark)
    las.register(spark)
    for kind, write in (("ply", records.write_ply), ("las", records.write_las), ("npycloud", records.write_npy)):
        path = str(tmp_path / kind)
        write(cloud.repartition(5), "file:" + path if kind == "ply" else path)
        got = spark.read.format(kind).option("block", "64").load(path)
        xs, want = ([r[0] for r in d.select("x").orderBy("x").collect()] for d in (got, cloud))
        assert np.allclose(xs, want, atol=6e-4) and got.select("point_id").distinct().count() == 500
    assert np.load(tmp_path / "npycloud").shape == (500, 6)
    assert spark.read.format("ply").load(str(tmp_path / "ply")).agg({"blue": "max"}).first()[0] == 255


def test_counts_come_from_the_file_not_the_header(spark, cloud, tmp_path):
    """A wrong count is passed over, a cut record at the end is no point."""
    las.register(spark)
    path = str(tmp_path / "a.las")
    records.write_las(cloud, path, stated=3)
    os.truncate(path, os.path.getsize(path) - 30)
    with open(path, "rb") as f:
        head = las.las_header(f.read(375), os.path.getsize(path))
    assert (head.points, head.stated, head.tail) == (498, 3, 22)
    assert spark.read.format("las").option("block", "100").load(path).count() == 498


def test_refusals(spark, cloud, tmp_path):
    with pytest.raises(ValueError, match="mounted"):
        records.write_ply(cloud, "s3://a/b.ply")
    with pytest.raises(ValueError, match="too wide"):
        records.write_las(cloud, str(tmp_path / "w"), scale=1e-10)
    with pytest.raises(ValueError, match="without a place"):
        records.write_las(spark.createDataFrame([(None, 1.0, 2.0)], "x double, y double, z double"), str(tmp_path / "n"))
