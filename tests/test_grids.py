"""Many grids at once: the same geometries as one grid at a time, and queries of them spread over tasks."""

import numpy as np
import pytest

from gridloom.geometry import affine_inverse, decompose, keep_axes, make_geometry, permute_axes, same_geometry, world_axes
from gridloom.grids import Grids, inverse, split
from gridloom.queries import QUERIES

from .conftest import DATA

GRID_QUERIES = [n for n in QUERIES if n.startswith("geometry_")] + ["progress_bar"]


def some(n=200):
    """Grids of turned, flipped and moved axes."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
    turn[::3] = np.round(np.eye(3)[rng.permuted(np.tile(np.arange(3), (n, 1)), axis=1)[::3]]) * rng.choice([-1, 1], (len(turn[::3]), 1, 3))
    world = np.zeros((n, 4, 4)) + np.eye(4)
    world[:, :3, :3], world[:, :3, 3] = turn * rng.uniform(0.5, 4, (n, 1, 3)), rng.normal(0, 50, (n, 3))
    return rng.integers(1, 60, (n, 3)), world


def test_batches_equal_single_grids():
    dims, world = some()
    g = Grids.make(dims, world_transform=world, unit="mm")
    one = [make_geometry(d, world_transform=w, unit="mm") for d, w in zip(dims, world, strict=True)]
    close = lambda a, b: np.testing.assert_allclose(a, np.array(b), rtol=1e-12, atol=1e-10)
    close(g.world_transform, world)
    close(g.voxel_size, [np.linalg.norm(w[:3, :3], axis=0) for w in world])
    close(g.centre, [w[:3, :3] @ ((d - 1) / 2) + w[:3, 3] for d, w in zip(dims, world, strict=True)])
    close(g.extent, [x.extent for x in one])
    close(g.world_axes, [world_axes(x) for x in one])
    close(inverse(world), [np.linalg.inv(w) for w in world])
    close(inverse(world), [affine_inverse(w) for w in world])
    for axes in ([0], [2], [0, 2], [2, 1], [0, 1, 2]):
        close(g.keep_axes(axes).world_transform, [keep_axes(x, axes).world_transform for x in one])
    for layout in ((3, -1, 2), (-1, -2, -3)):
        got, want = g.permute_axes(layout), [permute_axes(x, layout) for x in one]
        close(got.world_transform, [x.world_transform for x in want])
        close(got.centre, [x.centre for x in one])
        close(got.world_axes, [world_axes(x) for x in want])
    moved = g.with_voxel_size(1.25)
    assert g.same(moved).tolist() == [same_geometry(x, make_geometry(x.dims, 1.25, w)) for x, w in zip(one, world, strict=True)]
    assert g.same(g).all() and not g.same(Grids.make(dims, world_transform=world, unit="cm")).any()


def test_each_bad_transform_is_told():
    _, world = some(6)
    world[1, 0, 0] = np.nan
    world[2, :3, 1] = 0
    world[3, :3, 0] += 0.5 * world[3, :3, 1]
    world[4, 3] = 1
    fault = split(world, 3)[2]
    assert fault.tolist() == [0, 1, 2, 4, 1, 0]
    for w, f in zip(world, fault, strict=True):
        if f:
            with pytest.raises(ValueError):
                decompose(w, 3)
    with pytest.raises(ValueError, match="flatten"):
        Grids.make(np.ones((1, 3), int), world_transform=world[2:3])
    with pytest.raises(ValueError, match="singular"):
        inverse(world[2:3])


@pytest.mark.parametrize("name", GRID_QUERIES)
def test_grids_of_a_small_file_go_to_all_cores(spark, name):
    """The table of customers is one small file, which is one split."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
