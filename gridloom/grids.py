"""The geometries of many grids at once, for grids that are rows of a table: arrays with one grid after the other.

The rules are written once, over arrays with any leading axes: ``Geometry`` (one
grid, on the driver) and ``Grids`` (a batch of a task) both use them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property
from itertools import permutations

import numpy as np

#: How far an orientation may be from rigid.
TOLERANCE = 1e-4
#: What may be wrong with a world transform, by the numbers of ``split``.
FAULTS = ("", "a world transform is an affine 4x4 matrix", "a world transform may not flatten an axis", "axes beyond the spatial ones must have unit scale", "a world transform may not shear")


def padded(values: np.ndarray, n: int = 3, fill: float = 1.0) -> np.ndarray:
    """The first n values along the last axis, filled up."""
    values = np.asarray(values, float)[..., :n]
    return np.concatenate([values, np.full((*values.shape[:-1], n - values.shape[-1]), fill)], axis=-1)


def affine(turn: np.ndarray) -> np.ndarray:
    """Whether the last row is that of an affine matrix."""
    return np.isclose(turn[..., 3, :], [0, 0, 0, 1]).all(axis=-1)


def rigid(turn: np.ndarray) -> np.ndarray:
    """Whether a matrix neither scales nor shears."""
    axes = turn[..., :3, :3]
    return np.isclose(np.swapaxes(axes, -1, -2) @ axes, np.eye(3), atol=TOLERANCE).all(axis=(-1, -2))


def placed(turn: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Voxel (0-based) to world: the orientation's columns times the voxel sizes."""
    return turn * np.concatenate([padded(size), np.ones((*np.shape(size)[:-1], 1))], axis=-1)[..., None, :]


def at(world: np.ndarray, voxel: np.ndarray) -> np.ndarray:
    """World points of voxel points of three values."""
    return (world[..., :3, :3] @ voxel[..., None])[..., 0] + world[..., :3, 3]


def split(matrix: np.ndarray, n_axes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Voxel sizes and orientation of transforms, and the number of what is wrong with each (0: nothing)."""
    finite = np.isfinite(matrix).all(axis=(-1, -2)) & affine(matrix)
    matrix = np.where(finite[..., None, None], matrix, np.eye(4))
    norms = np.linalg.norm(matrix[..., :3, :3], axis=-2)
    flat = np.any(norms < 1e-12, axis=-1)
    turn = np.zeros(matrix.shape) + np.eye(4)
    turn[..., :3, :3] = matrix[..., :3, :3] / np.where(flat[..., None], 1.0, norms)[..., None, :]
    turn[..., :3, 3] = matrix[..., :3, 3]
    scaled = np.any(np.abs(norms[..., n_axes:] - 1) > TOLERANCE, axis=-1)
    fault = np.select([~finite, flat, scaled, ~rigid(turn)], [1, 2, 3, 4], 0)
    return padded(norms, n_axes), turn, fault


def same(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Whether transforms are equal, by mean relative difference."""
    gap, size = np.abs(a - b).mean(axis=(-1, -2)), np.abs(a).mean(axis=(-1, -2))
    return np.where(size > tolerance, gap / np.where(size > tolerance, size, 1.0), gap) < tolerance


def inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverses of affine matrices; singular ones are refused."""
    matrix = np.asarray(matrix, float)
    if np.any(np.abs(np.linalg.det(matrix[..., :3, :3])) < 1e-12):
        raise ValueError("the transform is singular")
    out = np.zeros(matrix.shape) + np.eye(4)
    out[..., :3, :3] = np.linalg.inv(matrix[..., :3, :3])
    out[..., :3, 3] = -(out[..., :3, :3] @ matrix[..., :3, 3, None])[..., 0]
    return out


def kept(turn: np.ndarray, size: np.ndarray, dims: np.ndarray, axes: list[int]) -> np.ndarray:
    """Orientations of kept axes (0-based, in order), in the middle of the dropped line or plane."""
    middle = np.zeros((*np.shape(dims)[:-1], 3))
    for a in range(min(3, np.shape(dims)[-1])):
        if a not in axes:
            middle[..., a] = (np.asarray(dims)[..., a] - 1) / 2
    out = np.zeros(turn.shape) + np.eye(4)
    out[..., :3, :3] = turn[..., :3, [a for a in axes if a < 3] + [a for a in range(3) if a not in axes]]
    out[..., :3, 3] = at(placed(turn, size), middle)
    return out


def permuted(turn: np.ndarray, size: np.ndarray, dims: np.ndarray, layout: tuple[int, ...]) -> np.ndarray:
    """Orientations of the view whose axis k is the signed axis layout[k]."""
    size, dims = padded(size), np.asarray(dims)
    out = np.zeros(turn.shape) + np.eye(4)
    origin = turn[..., :3, 3].copy()
    for k, signed in enumerate(layout[:3]):
        a = abs(signed) - 1
        out[..., :3, k] = turn[..., :3, a] * np.sign(signed)
        if signed < 0:
            origin += turn[..., :3, a] * (size[..., a] * (dims[..., a] - 1))[..., None]
    for k in range(min(dims.shape[-1], 3), 3):
        out[..., :3, k] = turn[..., :3, k]
    out[..., :3, 3] = origin
    return out


def directions(turn: np.ndarray, n_axes: int) -> np.ndarray:
    """The signed world axis of each spatial axis: the best joint assignment, the first of equals."""
    n = min(3, n_axes)
    ways = list(permutations(range(3), n))
    fit = np.stack([np.round(sum(np.abs(turn[..., w, a]) for a, w in enumerate(p)), 12) for p in ways], axis=-1)
    best = np.array(ways)[fit.argmax(axis=-1)]
    sign = np.sign(np.take_along_axis(turn[..., :3, :n], best[..., None, :], axis=-2)[..., 0, :])
    return np.where(sign == 0, 1, sign).astype(int) * (best + 1)


@dataclass(frozen=True, eq=False)
class Grids:
    """Geometries of grids with as many axes each and one unit: a row of each array is a grid."""

    dims: np.ndarray
    voxel_size: np.ndarray
    orientation: np.ndarray
    unit: str | None = None

    def __post_init__(self):
        if self.dims.shape != self.voxel_size.shape or self.orientation.shape != (len(self.dims), 4, 4):
            raise ValueError("there must be one voxel size for each axis and one 4x4 orientation for each grid")
        if np.any(self.dims < 0) or not np.all(np.isfinite(self.voxel_size)) or np.any(self.voxel_size <= 0):
            raise ValueError("grid dimensions must not be negative, voxel sizes must be positive")
        if not np.all(affine(self.orientation) & rigid(self.orientation)):
            raise ValueError("an orientation must be affine and rigid: no scale, no shear")

    @staticmethod
    def make(dims: np.ndarray, voxel_size=None, world_transform: np.ndarray | None = None, unit: str | None = None, template: Grids | None = None) -> Grids:
        """As make_geometry: each property from the first that says it."""
        if template is not None:
            if not np.array_equal(template.dims, dims):
                raise ValueError("the template is for grids of other dimensions")
            made = template if world_transform is None else template.with_transform(world_transform)
            made = made if voxel_size is None else made.with_voxel_size(voxel_size)
            return made if unit is None else replace(made, unit=unit)
        plain = Grids(dims, np.ones(dims.shape), np.zeros((len(dims), 4, 4)) + np.eye(4), unit)
        placed_ = plain if world_transform is None else plain.with_transform(world_transform)
        return placed_ if voxel_size is None else placed_.with_voxel_size(voxel_size)

    @cached_property
    def world_transform(self) -> np.ndarray:
        return placed(self.orientation, self.voxel_size)

    @property
    def centre(self) -> np.ndarray:
        return at(self.world_transform, padded((self.dims - 1) / 2, fill=0.0))

    @property
    def extent(self) -> np.ndarray:
        return self.dims * self.voxel_size

    @property
    def world_axes(self) -> np.ndarray:
        return directions(self.orientation, self.dims.shape[1])

    def with_voxel_size(self, voxel_size) -> Grids:
        return replace(self, voxel_size=np.broadcast_to(np.asarray(voxel_size, float), self.dims.shape))

    def with_transform(self, world_transform: np.ndarray) -> Grids:
        size, turn, fault = split(world_transform, self.dims.shape[1])
        if fault.any():
            raise ValueError(FAULTS[fault.max()])
        return replace(self, voxel_size=size, orientation=turn)

    def same(self, other: Grids, tolerance: float = 1.5e-8) -> np.ndarray:
        """Of each grid whether it is the other's; units are compared where both are known."""
        units = not (self.unit and other.unit and self.unit != other.unit)
        return (self.dims == other.dims).all(axis=1) & same(self.world_transform, other.world_transform, tolerance) & units

    def keep_axes(self, axes: list[int]) -> Grids:
        return Grids(self.dims[:, axes], self.voxel_size[:, axes], kept(self.orientation, self.voxel_size, self.dims, axes), self.unit)

    def permute_axes(self, layout: tuple[int, ...]) -> Grids:
        of = [abs(s) - 1 for s in layout]
        return Grids(self.dims[:, of], self.voxel_size[:, of], permuted(self.orientation, self.voxel_size, self.dims, layout), self.unit)
