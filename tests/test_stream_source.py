"""The stream source against numpy: conditions, partitions, gzip, parts, writing."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.image import from_numpy
from gridloom.sources import stream_source
from gridloom.sources.codec import StorageDescriptor, write_image

DIMS = (5, 7, 12)


def options(path, **more):
    return {"path": str(path), "type": "int16", "axes": "i,j,k", "dims": "5,7,12", **more}


def values():
    return np.arange(420, dtype="<i2") * 7 % 331


def rows_where(rule):
    x = values().reshape(DIMS, order="F")
    return sorted((i, j, k, int(x[i, j, k])) for i in range(5) for j in range(7) for k in range(12) if rule(i, j, k))


CONDITIONS = [({}, lambda i, j, k: True), ({"only.k": "3"}, lambda i, j, k: k == 3), ({"only.J": "5:", "only.k": ":1"}, lambda i, j, k: j > 4 and k <= 1), ({"only.k": "2,9,11,40", "only.i": "1,4"}, lambda i, j, k: k in (2, 9, 11) and i in (1, 4)), ({"only.i": "9"}, lambda i, j, k: False)]


@pytest.mark.parametrize("run", [4, 30, 100, 1000])
@pytest.mark.parametrize("form", ["plain", "gzip", "members", "parts"])
def test_partitions(tmp_path, monkeypatch, run, form):
    """The partitions hold all wanted values once and, of a plain file, not much else."""
    from gridloom.streaming.decode import member

    monkeypatch.setattr(stream_source, "RUN", run)
    raw, path = values().tobytes(), tmp_path / "x"
    if form == "parts":
        path.mkdir()
        for a, b in ((0, 100), (100, 350), (350, 420)):
            (path / str(a)).write_bytes(raw[2 * a : 2 * b])
    else:
        path.write_bytes({"plain": lambda: raw, "gzip": lambda: gzip.compress(raw), "members": lambda: member(raw[:300], 0) + member(raw[300:], 150)}[form]())
    for conditions, rule in CONDITIONS:
        reader = stream_source.ImageStream(options(path, **conditions)).reader(None)
        parts, want = reader.partitions(), rows_where(rule)
        got = [row for p in parts for batch in reader.read(p) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        assert sorted(got) == want
        if form in ("plain", "parts"):
            assert all(p.end - p.first <= run for p in parts)
            assert sum(p.end - p.first for p in parts) <= max(5 * run, len({(j, k) for _, j, k, _ in want}) * 5 + 35 * len({k for _, _, k, _ in want}))


def test_write_and_read(spark, tmp_path):
    stream_source.register(spark)
    x = values().reshape(DIMS, order="F")
    frame = spark.createDataFrame([(i, j, k, int(x[i, j, k])) for i in range(5) for j in range(7) for k in range(12)], "k_ int, j int, k int, v int").withColumnRenamed("k_", "i")
    o = options(tmp_path / "x", offset="3")
    frame.repartition(3).write.format(stream_source.NAME).options(**o).mode("append").save()
    assert (tmp_path / "x").read_bytes() == bytes(3) + values().tobytes()
    read = spark.read.format(stream_source.NAME).options(**o).load()
    some = spark.read.format(stream_source.NAME).options(**o, **{"only.k": "3", "only.j": "1,5", "only.i": ":1"}).load().where("v > 0")
    assert sorted(map(tuple, some.collect())) == [r for r in rows_where(lambda i, j, k: k == 3 and j in (1, 5) and i < 2) if r[3] > 0]
    assert read.where("k = 3").count() == 35 and read.where("k = 3").union(read.where("j = 2")).count() == 35 + 60  # one loaded table, several queries
    failing = [(frame.where("k < 11"), "lacks cells"), (frame.withColumn("k", F.lit(0)), "lacks cells"), (frame.withColumn("i", F.col("i") + 1), "out of range"), (frame.withColumn("v", F.lit(40_000)), "fit"), (frame.withColumn("v", F.lit(None).cast("int")), "missing")]
    for bad, message in failing:
        with pytest.raises(Exception, match=message):
            bad.write.format(stream_source.NAME).options(**o).mode("overwrite").save()
    with pytest.raises(Exception, match="x"):
        frame.write.format(stream_source.NAME).options(**o).mode("append").save()
    assert os.listdir(tmp_path) == ["x"] and read.count() == 420  # what was there stays
    nothing = frame.limit(0)
    empty = dict(o, path=str(tmp_path / "none"), dims="0,7,12")
    nothing.write.format(stream_source.NAME).options(**empty).mode("overwrite").save()
    assert spark.read.format(stream_source.NAME).options(**empty).load().count() == 0


def test_floats_and_images(spark, tmp_path):
    stream_source.register(spark)
    x = np.random.default_rng(8).normal(0, 3, DIMS)
    x[0, 0, :] = np.nan
    write_image(from_numpy(spark, x), str(tmp_path / "y.gz"), StorageDescriptor("float64", "big", offset=9))
    o = options(tmp_path / "y.gz", type="float64", endian="big", offset="9")
    got = spark.read.format(stream_source.NAME).options(**o, **{"only.k": "4:5"}).load().collect()
    assert len(got) == 70 and all(r.v is None if np.isnan(x[r.i, r.j, r.k]) else r.v == x[r.i, r.j, r.k] for r in got)
    for bad in (dict(o, axes="i,j"), dict(o, axes="i,v,k"), dict(o, type="bit"), dict(o, path="hdfs://a/b"), {**o, "only.z": "1"}):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.format(stream_source.NAME).options(**bad).load()
