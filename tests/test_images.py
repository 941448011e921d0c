"""Contracts of geometry and images, held against numpy with the first axis fastest."""

import gzip
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import points
from gridloom.geometry import decompose, make_geometry, permute_axes, same_geometry, world_axes
from gridloom.image import from_numpy, sparse_from_mask
from gridloom.operators import apply, elementwise, index
from gridloom.operators.reduce import imreduce, sparseness, summary
from gridloom.plans.layout import flatten
from gridloom.sources import codec
from gridloom.sources.codec import StorageDescriptor, read_image, write_image
from gridloom.streaming import decode

RNG = np.random.default_rng(5)
LAS = np.array([[-2.0, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1]])


def test_geometry_algebra():
    g = make_geometry((91, 109, 91), world_transform=LAS, unit="mm")
    assert g.voxel_size == (2, 2, 2) and world_axes(g) == (-1, 2, 3)
    assert np.allclose(g.world_transform, LAS) and np.allclose(g.centre, [0, -18, 18]) and np.allclose(g.extent, [182, 218, 182])
    flipped = permute_axes(g, (-1, 2, 3))
    assert world_axes(flipped) == (1, 2, 3) and np.allclose(flipped.centre, g.centre)
    assert same_geometry(g, g) and not same_geometry(g, flipped)
    shear = np.eye(4)
    shear[0, 1] = 0.3
    with pytest.raises(ValueError):
        decompose(shear, 3)
    with pytest.raises(ValueError):
        make_geometry((2, 2), voxel_size=(1, -1))


def test_points_round_trip(spark):
    g = make_geometry((91, 109, 91), world_transform=LAS)
    xyz = RNG.uniform(0, 80, (20, 3))
    df = spark.createDataFrame([tuple(map(float, p)) for p in xyz], "x double, y double, z double")
    back = points.from_voxel(points.to_voxel(df, g), g).toPandas().to_numpy()
    assert np.allclose(back, xyz)


@pytest.mark.parametrize("kind", ["world", "scaled", "voxel"])
def test_rounding(spark, kind):
    """Halves go to the even 0-based neighbour; draws stay between the neighbours, above 0 and below the bound."""
    g = make_geometry((10, 10, 10))
    xyz = [(1.2, 2.7, 3.5), (-0.4, 9.9, 4.5), (0.5, 1.5, 2.5), (9.6, 9.6, 9.6)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(xyz)], "k int, x double, y double, z double")
    one = 0 if kind == "voxel" else 1
    got = {r["k"]: np.array(tuple(r)[1:]) - one for r in points.to_voxel(df, g, kind, "conventional").collect()}
    assert all(np.array_equal(got[k], np.round(p)) for k, p in enumerate(xyz))
    for seed in range(5):
        for r in points.to_voxel(df, g, kind, "probabilistic", seed=seed).collect():
            p, v = np.array(xyz[r["k"]]), np.array(tuple(r)[1:]) - one
            assert np.all((v >= np.floor(p)) & (v <= np.ceil(p)) & (v <= 9) & (v >= 0))
    free = points.to_voxel(df.where("k = 3"), g, kind, "probabilistic", bounds=(99, 99, 99), seed=3).first()
    assert set(np.array(tuple(free)[1:]) - one) <= {9, 10}


@pytest.mark.parametrize("what,fun", [("sum", np.sum), ("mean", np.mean), ("min", np.min), ("max", np.max), ("var", lambda x: np.var(x, ddof=1)), ("which.min", lambda x: int(np.argmin(x)) + 1), ("which.max", lambda x: int(np.argmax(x)) + 1), ("prod", np.prod), ("any", lambda x: bool(np.any(x))), ("all", lambda x: bool(np.all(x)))])
def test_reductions_agree_in_all_forms(spark, what, fun):
    a = np.where(np.abs(x := RNG.normal(size=(3, 4, 5))) < 0.7, 0, np.round(x, 1))
    a[:, 1, 2] = 0
    dense = from_numpy(spark, a)
    for image in (dense, dense.as_sparse(), dense.as_packed("float32")):
        got = {(r["m1"], r["m2"]): r["v"] for r in imreduce(image, [3, 2], what).collect()}
        assert len(got) == 20
        for (k, j), v in got.items():
            assert v == pytest.approx(fun(a[:, j, k].ravel(order="F")), abs=1e-5), (image.kind, what, k, j)


def test_missing_values(spark):
    a = np.arange(12.0).reshape(3, 4)
    a[0, 1] = np.nan
    image = from_numpy(spark, a, spatial=2)
    assert {r["m1"]: r["v"] for r in imreduce(image, 2, "sum").collect()}[1] is None
    assert {r["m1"]: r["v"] for r in imreduce(image, 2, "sum", na_rm=True).collect()}[1] == 14
    assert {r["m1"]: r["v"] for r in imreduce(image, 2, "countNA").collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    assert {r["m1"]: r["v"] for r in imreduce(image, 2, "any").collect()}[1] is True
    assert np.isnan(image.as_sparse().as_dense().to_numpy()[0, 1])
    with pytest.raises(ValueError):
        image.as_packed("int8")


def test_partitions_never_change_results(spark):
    a = RNG.normal(size=(4, 5, 6)).round(2)
    want = None
    for n in (1, 7):
        image = apply.with_threads(from_numpy(spark, a), n)
        got = sorted(map(tuple, imreduce(image, [1], "which.max").collect()))
        want = want or got
        assert got == want


def test_sparse_algebra(spark):
    a = np.zeros((4, 4, 2))
    a[1, 2, 0], a[3, 3, 1] = 2, -1
    s = from_numpy(spark, a).as_sparse()
    assert sparseness(s) == 1 - 2 / 32 and summary(s, "sum") == 1 and summary(s, "min") == -1 and summary(s, "all") is False
    assert elementwise.binary(s, "*", 2).is_sparse and elementwise.binary(s, "+", 1).is_dense and elementwise.binary(s, ">", 0).is_sparse
    assert elementwise.binary(s, "-", s).cells.count() == 0
    assert np.allclose(elementwise.binary(s, "/", 0).to_numpy()[a != 0], [np.inf, -np.inf])
    assert elementwise.math(s, "sin").is_sparse and elementwise.math(s, "cos").is_dense
    m = sparse_from_mask(spark, a != 0, np.array([5.0, 6.0]))
    assert np.allclose(m.to_numpy(), np.where(a == 2, 5, np.where(a == -1, 6, 0)))


def test_operators_agree_in_all_forms(spark):
    """Numbers, arrays and images on either side; sparse stays sparse where zero stays zero."""
    a, b = (np.where(np.abs(x := RNG.normal(size=(4, 3, 2))) < 0.8, 0, np.round(x, 1)) for _ in range(2))
    s, t = from_numpy(spark, a).as_sparse(), from_numpy(spark, b).as_sparse()
    w = np.arange(24.0).reshape(4, 3, 2, order="F")
    cases = [
        (lambda x, y: x * 2, True), (lambda x, y: x / 2, True), (lambda x, y: 2 * x, True), (lambda x, y: 0 - x, True), (lambda x, y: x - x, True), (lambda x, y: x * x, True), (lambda x, y: x**2, True), (lambda x, y: x % 2, True),
        (lambda x, y: x > 0, True), (lambda x, y: x < 0, True), (lambda x, y: abs(x), True), (lambda x, y: -x, True), (lambda x, y: +x, True), (lambda x, y: x + 1, False), (lambda x, y: 1 + x, False), (lambda x, y: x - 1, False),
        (lambda x, y: x == 0, False), (lambda x, y: x * y, True), (lambda x, y: x + y, True), (lambda x, y: x - y, True), (lambda x, y: x > y, True), (lambda x, y: x == y, False), (lambda x, y: 3 - x, False), (lambda x, y: x + w, False), (lambda x, y: w - x, False),
    ]
    for n, (f, sparse) in enumerate(cases):
        got, want = f(s, t), f(a, b)
        assert got.is_sparse == sparse, n
        assert np.allclose(got.to_numpy().astype(float), want.astype(float)), n
        if n not in (17, 18, 19, 20, 21):
            dense = f(from_numpy(spark, a), from_numpy(spark, b))
            assert dense.is_dense and np.allclose(dense.to_numpy().astype(float), want.astype(float)), n
    recycled = (s + np.array([1.0, 2.0])).to_numpy()
    assert np.allclose(recycled, a + np.resize([1.0, 2.0], 24).reshape(4, 3, 2, order="F"))
    with pytest.raises(ValueError):
        s + np.zeros((2, 2, 2))
    with pytest.raises(TypeError):
        elementwise.binary(1, "+", 2)


@pytest.mark.parametrize("to", [(1, 2, 3), (-1, 2, 3), (3, 1, -2)])
def test_views(spark, to):
    a = np.where(np.abs(x := RNG.normal(size=(3, 4, 5, 2))) < 0.5, 0, x)
    image = from_numpy(spark, a)
    dense = image.reorient(to).to_numpy()
    axes = [abs(t) - 1 for t in to]
    want = np.transpose(a, [*axes, 3])
    for k, t in enumerate(to):
        want = np.flip(want, k) if t < 0 else want
    assert np.allclose(dense, want)
    assert np.allclose(image.as_sparse().reorient(to).to_numpy(), want)


def test_extract_and_assign(spark):
    a = RNG.normal(size=(3, 4, 2)).round(3)
    image = from_numpy(spark, a)
    assert np.allclose(index.extract(image, None, [4, 1], 2).to_numpy(), a[:, [3, 0], 1])
    assert np.allclose(index.extract(image, -1, [True, False], None).to_numpy(), a[1:, ::2, :])
    b = a.copy()
    b[1, :, 0] = 9
    for x in (image, image.as_sparse(), image.as_packed("float32")):
        assert np.allclose(index.assign(x, 9.0, 2, None, 1).to_numpy(), b, atol=1e-6)
    flat = a.ravel(order="F")
    for x in (image, image.as_sparse(), image.as_packed("float32")):
        near = lambda got, want: np.allclose(got.to_numpy(), want, atol=1e-6)
        assert near(x[x > 0], flat[flat.astype(np.float32) > 0]) and near(x[[5, 1, 5]], flat[[4, 0, 4]]) and near(x[-np.arange(3, 9)], np.delete(flat, np.arange(2, 8)))
        assert near(x[np.array([True, False, False])], flat[::3]) and near(x[np.array([[1, 2, 1], [3, 4, 2]])], [a[0, 1, 0], a[2, 3, 1]]) and near(x[[3, 1, 1], :, 2], a[[2, 0, 0], :, 1])
    some = a.copy()
    some[[0, 2], 1, :] = np.array([[1, 3], [2, 1]])
    assert np.allclose(index.assign(image, [1, 2, 3], [1, 3], 2, None).to_numpy(), some)
    for bad in ([5], [1, -1], ["a"]):
        with pytest.raises((IndexError, ValueError, TypeError)):
            index.extract(image, bad, None, None)


def test_apply(spark):
    a = RNG.normal(size=(3, 4, 2, 5))
    image = from_numpy(spark, a)
    assert np.allclose(apply.voxel_apply(image, np.median).to_numpy(), np.median(a, axis=3))
    assert np.allclose(apply.slice_apply(image, np.std, axis=3).to_numpy(), a.std(axis=(0, 1, 3)))
    mask = from_numpy(spark, a[..., 0] > 0)
    assert np.allclose(apply.voxel_apply(image, np.max, mask=mask, fill=-7).to_numpy(), np.where(a[..., 0] > 0, a.max(axis=3), -7))
    wide = apply.voxel_apply(image, lambda v: [v.min(), v.max()], length=2).to_numpy()
    assert np.allclose(wide[1], a.max(axis=3))
    with pytest.raises(ValueError):
        apply.voxel_apply(from_numpy(spark, a[..., 0]), np.mean)
    with pytest.raises(Exception, match="no luck"):
        apply.imapply(image, [1], lambda v: (_ for _ in ()).throw(RuntimeError("no luck"))).collect()
    called = []
    assert apply.imapply(from_numpy(spark, np.zeros((0, 3, 2))), [1], lambda v: called.append(v.shape)).count() == 0 and called == [(3, 2)]


def test_bounds_of_indices(spark):
    rows = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    p = flatten([F.col("i"), F.col("j")], (2, 3), check=True).alias("p")
    assert rows.where("j < 3").select(p).first()["p"] == 5
    with pytest.raises(Exception, match="out of bounds"):
        rows.select(p).collect()


def test_strided_runs(spark):
    v = np.array([5, 3, 8, 1, 9, 2, 7, 4, 6, 0.0])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pos long, v double")
    for start, stride in ((0, 1), (1, 2), (2, 3), (9, 4), (12, 2)):
        for fun, order in ((index.strided_reverse, lambda x: x[::-1]), (index.strided_sort, np.sort)):
            want = v.copy()
            want[start::stride] = order(want[start::stride])
            assert [r["v"] for r in fun(df, start, stride).orderBy("pos").collect()] == want.tolist()


@pytest.mark.parametrize("kind", ["int8", "uint8", "int16", "int32", "int64", "float32", "float64", "bit", "complex64", "complex128", "rgb24"])
@pytest.mark.parametrize("endian", ["little", "big"])
def test_codec_round_trips(spark, tmp_path, kind, endian):
    shape = (4, 3, 2, 2)
    a = RNG.integers(0, 100, (4, 3, 2, 3) if kind == "rgb24" else shape).astype(float)
    a = RNG.random(shape) > 0.5 if kind == "bit" else a + 1j * a[::-1] if kind.startswith("complex") else a
    d = StorageDescriptor(kind, endian, offset=17, bit_order="msb" if endian == "big" else "lsb")
    path = str(tmp_path / "x.raw")
    used = write_image(from_numpy(spark, a), path, d)
    back = read_image(spark, path, used, shape[:3] if kind == "rgb24" else shape, form="dense").to_numpy()
    if kind.startswith("complex"):
        assert np.allclose([x[0] + 1j * x[1] for x in back.ravel()], a.ravel())
    else:
        assert np.allclose(back.astype(float), a)


def test_codec_volumes_gzip_and_errors(spark, tmp_path):
    a = RNG.integers(-50, 50, (3, 2, 2, 4)).astype(float)
    path = str(tmp_path / "x.gz")
    used = write_image(from_numpy(spark, a), path, StorageDescriptor("int16"))
    assert np.allclose(read_image(spark, path, used, a.shape, volumes=[4, 2, 4]).to_numpy(), a[..., [3, 1, 3]])
    with pytest.raises(Exception, match="ends before"):
        read_image(spark, path, used, (3, 2, 2, 9)).cells.collect()
    foreign = str(tmp_path / "y.gz")  # a gzip file of one member that says nothing of itself
    with gzip.open(path, "rb") as f, gzip.open(foreign, "wb") as g:
        g.write(f.read())
    assert np.allclose(read_image(spark, foreign, used, a.shape, volumes=[4, 2, 4]).to_numpy(), a[..., [3, 1, 3]])
    with pytest.raises(ValueError):
        write_image(from_numpy(spark, a + 0.5), path, StorageDescriptor("int64"))


@pytest.mark.parametrize("kind", ["int16", "bit"])
def test_codec_gzip_in_many_tasks(spark, tmp_path, monkeypatch, kind):
    """Members are written and read by many tasks, and any gzip reader takes them as one stream."""
    monkeypatch.setattr(codec, "MASK_BLOCK", 64)
    a = RNG.integers(-50, 50, (13, 5, 4, 6)).astype(float)
    a = a > 0 if kind == "bit" else a
    for offset in (0, 17):
        path = str(tmp_path / f"{kind}{offset}.gz")
        used = write_image(from_numpy(spark, a), path, StorageDescriptor(kind, offset=offset))
        chain = decode.members(path)
        assert len(chain) > 10 and chain[0][0] == -offset
        with gzip.open(path, "rb") as f:
            flat = a.ravel(order="F")
            assert f.read() == bytes(offset) + (np.packbits(flat, bitorder="little") if kind == "bit" else flat.astype("<i2")).tobytes()
        for more, want in (({}, a), ({"volumes": [5, 2, 5]}, a[..., [4, 1, 4]])):
            image = read_image(spark, path, used, a.shape, form="dense", **more)
            assert np.array_equal(image.to_numpy().astype(float), want.astype(float))
        assert image.cells.rdd.getNumPartitions() > 1
    with pytest.raises(ValueError, match="offset"):
        read_image(spark, path, StorageDescriptor(kind, offset=3), a.shape)
    bits = str(tmp_path / "plain.gz")
    if kind == "bit":  # read forward, by the volume
        with gzip.open(bits, "wb") as g:
            g.write(np.packbits(a.ravel(order="F"), bitorder="little").tobytes())
        for volumes in ([1, 2, 3, 4, 5, 6], [2, 3], [6, 1]):
            got = read_image(spark, bits, StorageDescriptor("bit"), a.shape, form="dense", volumes=volumes).to_numpy()
            assert np.array_equal(got.astype(bool), a[..., [v - 1 for v in volumes]])


def test_codec_writes_one_file_by_all_tasks(spark, tmp_path):
    a = RNG.integers(-50, 50, (50, 7, 12)).astype(float)
    image = from_numpy(spark, a)
    path = str(tmp_path / "x.raw")
    write_image(replace(image, cells=image.cells.repartition(7)), path, StorageDescriptor("int16", "big", offset=5))
    with open(path, "rb") as f:
        assert f.read() == bytes(5) + a.ravel(order="F").astype(">i2").tobytes()
    for cells in (image.cells.where("loc <> 7"), image.cells.where("loc <> 7").union(image.cells.where("loc = 8"))):
        with pytest.raises(Exception, match="lacks cells"):
            write_image(replace(image, cells=cells), str(tmp_path / "bad.raw"), StorageDescriptor("int16"))
    assert os.listdir(tmp_path) == ["x.raw"]  # nothing is left behind


def test_codec_reads_what_only_spark_can_open(spark, tmp_path):
    """Streams of any Hadoop file system, here a mount table that Python cannot open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./data", f"file://{tmp_path}")
    a = RNG.integers(-50, 50, (13, 5, 4, 6)).astype(float)
    image = from_numpy(spark, a)
    image = replace(image, cells=image.cells.repartition(5))
    for ending, offset in (("raw", 9), ("gz", 9), ("parts", 0)):
        used = write_image(image, f"{tmp_path}/x.{ending}", StorageDescriptor("int16", "big", offset=offset))
        far = f"viewfs://far/data/x.{ending}"
        assert np.array_equal(read_image(spark, far, used, a.shape).to_numpy(), a)
        assert np.array_equal(read_image(spark, far, used, a.shape, volumes=[5, 2, 5]).to_numpy(), a[..., [4, 1, 4]])
    bits = write_image(image > 0, f"{tmp_path}/b.raw", StorageDescriptor("bit", offset=3))
    assert np.array_equal(read_image(spark, "viewfs://far/data/b.raw", bits, a.shape).to_numpy().astype(bool), a > 0)
    with pytest.raises(Exception, match="ends before"):
        read_image(spark, "viewfs://far/data/x.raw", used, (13, 5, 4, 9)).cells.collect()
