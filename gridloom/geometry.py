"""Geometry of a grid: extent, voxel size, rigid placement, unit. Driver-side algebra, no Spark job.

Axes are 1-based in the public interface. A transform is a 4x4 affine matrix; it
splits into an orientation (rigid) and voxel sizes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from . import grids


@dataclass(frozen=True)
class Geometry:
    dims: tuple[int, ...]
    voxel_size: tuple[float, ...]
    orientation: tuple[tuple[float, ...], ...]
    unit: str | None = None

    def __post_init__(self):
        size, turn = np.array(self.voxel_size, float), np.array(self.orientation, float)
        if any(d < 0 or d != int(d) for d in self.dims) or not self.dims:
            raise ValueError("grid dimensions must be non-negative integers")
        if len(size) != len(self.dims) or not np.all(np.isfinite(size)) or np.any(size <= 0):
            raise ValueError("there must be one positive voxel size for each axis")
        if turn.shape != (4, 4) or not grids.affine(turn):
            raise ValueError("an orientation is an affine 4x4 matrix")
        if not grids.rigid(turn):
            raise ValueError("an orientation must be rigid: no scale, no shear")

    @property
    def world_transform(self) -> np.ndarray:
        """Voxel (0-based) to world: the orientation's columns times the voxel sizes."""
        return grids.placed(np.array(self.orientation), np.array(self.voxel_size))

    @property
    def centre(self) -> np.ndarray:
        """World point of the grid's middle; always three values."""
        return grids.at(self.world_transform, grids.padded((np.array(self.dims) - 1) / 2, fill=0.0))

    @property
    def extent(self) -> np.ndarray:
        return np.array(self.dims) * np.array(self.voxel_size)

    def __repr__(self) -> str:
        size = " x ".join(f"{s:g}" for s in self.voxel_size)
        return f"<Geometry {' x '.join(map(str, self.dims))}, voxels {size}{' ' + self.unit if self.unit else ''}>"


def decompose(transform, n_axes: int) -> tuple[tuple[float, ...], np.ndarray]:
    """Voxel sizes and rigid orientation of a transform; shear, zero axes and scale beyond the axes are refused."""
    matrix = np.array(transform, float)
    if matrix.shape != (4, 4):
        raise ValueError(grids.FAULTS[1])
    size, turn, fault = grids.split(matrix, n_axes)
    if fault:
        raise ValueError(grids.FAULTS[fault])
    return tuple(size.tolist()), turn


def _tuples(matrix: np.ndarray) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(float(x) for x in row) for row in np.asarray(matrix))


def make_geometry(dims, voxel_size=None, world_transform=None, unit: str | None = None, template: Geometry | None = None) -> Geometry:
    """Each property from the first that says it: the argument, what an explicit transform implies, the template, the default."""
    dims = tuple(int(d) for d in dims)
    if template is not None:
        if template.dims != dims:
            raise ValueError("the template is for a grid of other dimensions")
        made = template if world_transform is None else with_transform(template, world_transform)
        made = made if voxel_size is None else with_voxel_size(made, voxel_size)
        return made if unit is None else replace(made, unit=unit)
    implied, turn = decompose(world_transform, len(dims)) if world_transform is not None else ((1.0,) * len(dims), np.eye(4))
    size = implied if voxel_size is None else tuple(float(s) for s in np.broadcast_to(voxel_size, (len(dims),)))
    return Geometry(dims, size, _tuples(turn), unit)


def same_geometry(x: Geometry, y: Geometry, tolerance: float = 1.5e-8) -> bool:
    """Equal dims; units compared only where both are known; transforms by mean relative difference."""
    if x.dims != y.dims or (x.unit and y.unit and x.unit != y.unit):
        return False
    return bool(grids.same(x.world_transform, y.world_transform, tolerance))


def affine_inverse(matrix) -> np.ndarray:
    return grids.inverse(matrix)


def keep_axes(g: Geometry, axes: list[int]) -> Geometry | None:
    """The geometry of the kept axes (0-based, in order); it sits in the middle of the dropped line or plane."""
    if not axes:
        return None
    out = grids.kept(np.array(g.orientation), np.array(g.voxel_size), np.array(g.dims), axes)
    return Geometry(tuple(g.dims[a] for a in axes), tuple(g.voxel_size[a] for a in axes), _tuples(out), g.unit)


def permute_axes(g: Geometry, layout: tuple[int, ...]) -> Geometry:
    """The geometry of a view whose axis k is the signed axis layout[k] of g."""
    out = grids.permuted(np.array(g.orientation), np.array(g.voxel_size), np.array(g.dims), layout)
    return Geometry(tuple(g.dims[abs(s) - 1] for s in layout), tuple(g.voxel_size[abs(s) - 1] for s in layout), _tuples(out), g.unit)


def world_axes(g: Geometry) -> tuple[int, ...]:
    """The signed world axis of each spatial axis: the best joint assignment, the first of equals."""
    return tuple(grids.directions(np.array(g.orientation), len(g.dims)).tolist())


def with_voxel_size(g: Geometry, voxel_size) -> Geometry:
    """Another size of the voxels; what is checked is the final state only."""
    return replace(g, voxel_size=tuple(float(s) for s in np.broadcast_to(voxel_size, (len(g.dims),))))


def with_transform(g: Geometry, world_transform) -> Geometry:
    size, turn = decompose(world_transform, len(g.dims))
    return replace(g, voxel_size=size, orientation=_tuples(turn))
