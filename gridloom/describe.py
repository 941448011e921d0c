"""Summaries of geometries, images and storage descriptors as text, and the line of a progress bar."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from math import isfinite, log10, prod

from .geometry import Geometry
from .image import PACKED, Image
from .operators.reduce import sparseness
from .plans import layout as L
from .sources.codec import StorageDescriptor

#: The lines of a summary (fixed formats).
LINES = {
    "geometry": "Image geometry: {dims}",
    "dense": "Dense image: {dims} ({type})",
    "sparse": "Sparse image: {dims} ({type})",
    "packed": "Packed image: {dims} ({type})",
    "spatial": "  Spatial dimensions : {dims}",
    "voxels": "  Voxel size         : {size} {unit}",
    "elements": "  Values per location: {n}",
    "stored": "  Locations stored   : {present:,} of {all:,} ({share:.1f}% sparse)",
    "scaling": "  Scaling            : value = stored * {slope:g} + {intercept:g}",
    "bytes": "  Storage            : {own:,} bytes, against {double:,} as double",
    "layout": "  Storage layout     : {layout}",
    "descriptor": "Storage descriptor: {type}, {endian}-endian, from byte {offset}",
    "descriptor scaling": "  Scaling: value = stored * {slope:g} + {intercept:g}",
    "descriptor layout": "  Layout : {layout}",
}


def _times(values) -> str:
    return " x ".join(map(str, values))


def _grid(g: Geometry) -> list[str]:
    size = _times(f"{s:.4g}" for s in g.voxel_size)
    return [LINES["spatial"].format(dims=_times(g.dims)), LINES["voxels"].format(size=size, unit=g.unit or "(unit unknown)")]


def _descriptor(d: StorageDescriptor) -> list[str]:
    out = [LINES["descriptor"].format(type=d.type, endian=d.endian, offset=d.offset)]
    if d.slope is not None or d.intercept is not None:
        out.append(LINES["descriptor scaling"].format(slope=1 if d.slope is None else d.slope, intercept=d.intercept or 0))
    if d.layout and tuple(d.layout) != L.identity(len(d.layout)):
        out.append(LINES["descriptor layout"].format(layout=", ".join(map(str, d.layout))))
    return out


def describe(x: Geometry | Image | StorageDescriptor) -> str:
    """A summary in lines; for a sparse image its locations are counted by a job."""
    if isinstance(x, StorageDescriptor):
        return "\n".join(_descriptor(x))
    if isinstance(x, Geometry):
        return "\n".join([LINES["geometry"].format(dims=_times(x.dims)), *_grid(x)])
    out = [LINES[x.kind].format(dims=_times(x.dims), type=x.storage_type), *_grid(x.grid)]
    if x.spatial < len(x.dims):
        out.append(LINES["elements"].format(n=x.n_elements))
    if x.is_sparse:
        share = sparseness(x)
        out.append(LINES["stored"].format(present=round((1 - share) * x.n_locations), all=x.n_locations, share=100 * share))
    if x.is_packed:
        if (x.slope, x.intercept) != (1, 0):
            out.append(LINES["scaling"].format(slope=x.slope, intercept=x.intercept))
        out.append(LINES["bytes"].format(own=int(PACKED[x.stored][3][1]) * prod(x.dims), double=8 * prod(x.dims)))
    if x.layout != L.identity(len(x.dims)):
        out.append(LINES["layout"].format(layout=", ".join(map(str, x.layout))))
    return "\n".join(out)


def rate(per_second: float) -> str:
    """A rate in at most three figures and a letter for its thousands."""
    if not isfinite(per_second):
        return "--".rjust(6)
    step = min(4, max(0, int(log10(per_second) // 3))) if per_second >= 1 else 0
    scaled = per_second / 1000**step
    return f"{scaled:.{0 if scaled >= 100 else 1}f}{['', 'k', 'M', 'G', 'T'][step]}".rjust(6)


def bar(done: int, total: int, seconds: float, width: int = 80) -> str:
    """One line: the bar, the share done, the voxels a second."""
    share = min(1.0, done / total) if total else 1.0
    tail = f"{100 * share:3.0f}%  {rate(done / seconds if seconds > 0 else float('nan'))} voxels/s"
    room = max(10, width - len(tail) - 6)
    return f"  |{'=' * round(share * room)}{' ' * (room - round(share * room))}| {tail}"


def progress_bar(out=sys.stderr, width: int = 80) -> Callable[[int, int], None]:
    """A callback for with_progress that draws the bar over itself."""
    began = time.monotonic()

    def draw(done: int, total: int) -> None:
        out.write("\r" + bar(done, total, time.monotonic() - began, width) + ("\n" if done >= total else ""))
        out.flush()

    return draw
