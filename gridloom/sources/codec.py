"""Codec between raw byte streams and images.

Reading: one task per run of values of a seekable file, or per member of a gzip
file written here (one task in all for other gzip files); chosen volumes and a mask are applied while decoding, so what is not wanted
never becomes a row (the mask as a bit a location, up to 64 MB; larger ones are
joined). Writing: values are range-partitioned by stream position and every task
writes its own at their place in one file, which takes the target's name once all
are there; a task that runs twice writes the same bytes. Gzip members have places
once all are packed, so they go to parts first and are copied from there by tasks.
A target whose name ends in .parts stays a folder of parts, each named by its
first position, and reading takes it as the same stream. Nothing passes through
the driver. Files are written to and read from paths that all workers see; files
at a path that only Spark's readers can open (another scheme than file) are read
whole, one to a row, those without a wanted value not at all.
"""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.exact import missing
from ..geometry import Geometry
from ..image import PACKED, Image, calibrate, from_cells, tighten, wide_enough
from ..operators.elementwise import mask_locations
from ..plans import layout as L
from ..streaming.decode import MemberStream, chunks, is_seekable, member, members, open_bytes, open_stream, skip

#: Stream types: numpy code, and bytes of a value.
TYPES = {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "float32": "f4", "float64": "f8", "complex64": "c8", "complex128": "c16", "rgb24": "u1", "rgba32": "u1", "bit": "u1"}
#: The next wider integer type of a stream.
WIDER = {"int8": "int16", "uint8": "uint16", "int16": "int32", "uint16": "uint32", "int32": "int64", "uint32": "int64"}
ALIASES = {"char": "uint8", "int": "int32", "float": "float32", "double": "float64"}
CHANNELS = {"rgb24": 3, "rgba32": 4}
#: Values that one read task decodes.
RUN = 1 << 22
#: Locations of a mask that is sent to the decoders as bits, and those of one block of it.
MOST_MASK, MASK_BLOCK = 1 << 29, 1 << 20


@dataclass(frozen=True)
class StorageDescriptor:
    type: str
    endian: str = "little"
    offset: int = 0
    slope: float | None = None
    intercept: float | None = None
    layout: tuple[int, ...] | None = None
    bit_order: str = "lsb"

    def __post_init__(self):
        object.__setattr__(self, "type", ALIASES.get(self.type, self.type))
        if self.type not in TYPES:
            raise ValueError(f"stream types are {', '.join(TYPES)}")
        if self.endian not in ("little", "big") or self.bit_order not in ("lsb", "msb"):
            raise ValueError("endian is little or big, bit order lsb or msb")
        if self.offset < 0 or self.offset != int(self.offset):
            raise ValueError("the offset is a whole number of bytes, not negative")
        if self.slope is not None and (not self.slope or not np.isfinite(self.slope)) or self.intercept is not None and not np.isfinite(self.intercept):
            raise ValueError("the slope must be finite and other than zero, the intercept finite")
        if self.type in (*CHANNELS, "bit", "complex64", "complex128") and (self.slope not in (None, 1.0) or self.intercept not in (None, 0.0)):
            raise ValueError(f"{self.type} values have no scaling")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(("<" if self.endian == "little" else ">") + TYPES[self.type])

    def __repr__(self) -> str:
        scale = "" if self.slope in (None, 1.0) and self.intercept in (None, 0.0) else f", x {self.slope:g} + {self.intercept or 0:g}"
        return f"<storage {self.type}, {self.endian} endian, offset {self.offset}{scale}>"


def _stream_layout(d: StorageDescriptor, dims: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The image's dims (with channels) and its layout in the stream, channels fastest there."""
    n = len(dims)
    layout = L.check_layout(d.layout or L.identity(n), n)
    if d.type not in CHANNELS:
        return dims, layout
    return (*dims, CHANNELS[d.type]), (*((abs(s) + 1) * (1 if s > 0 else -1) for s in layout), 1)


def _decode(raw: bytes, d: StorageDescriptor, packed: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Values, imaginary parts (complex) and which are missing."""
    x = np.frombuffer(raw, d.dtype)
    if d.type.startswith("complex"):
        return x.real.astype(float), x.imag.astype(float), np.isnan(x)
    if d.type == "int32" and not packed and np.any(x == -(2**31)):
        raise ValueError("a 32-bit value has no integer form; read it packed or as int64")
    if d.type == "int64" and np.any(np.abs(x.astype(float)) > 2**53):
        raise ValueError("a 64-bit value is beyond exact doubles")
    return x, None, np.isnan(x) if x.dtype.kind == "f" else np.zeros(len(x), bool)


def mask_bits(mask: Image, n_locations: int) -> np.ndarray:
    """A bit for each location, most significant first; made by blocks, n_locations / 8 bytes in all."""

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        here = np.zeros(MASK_BLOCK, bool)
        here[part.column("loc").to_numpy() % MASK_BLOCK] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(here).tobytes()])})

    block = F.call_function("div", F.col("loc"), F.lit(MASK_BLOCK)).alias("block")
    rows = mask_locations(mask, n_locations).select("loc", block).groupBy("block").applyInArrow(pack, "block long, bits binary").collect()
    out = np.zeros(-(-n_locations // MASK_BLOCK) * (MASK_BLOCK // 8), np.uint8)
    for r in rows:
        out[r["block"] * (MASK_BLOCK // 8) :][: MASK_BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def _remote_segments(spark: SparkSession, path: str, d: StorageDescriptor, total: int) -> list[tuple[int, int, str, int]]:
    """As _segments, for files of any file system; only their names and lengths are read."""
    found = {r["path"]: r["length"] for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()}
    named = {int(name): p for p in found if (name := p.rpartition("/")[2]).isdigit()}
    if not named or list(found) == [path]:
        return [(0, total, next(iter(found)), d.offset)]
    ends = [*sorted(named)[1:], total]
    for a, b in zip(sorted(named), ends, strict=True):
        if d.type != "bit" and found[named[a]] < (b - a) * d.dtype.itemsize:
            raise EOFError("the stream ends before the data")
    return [(a, b - a, named[a], 0) for a, b in zip(sorted(named), ends, strict=True)]


def _segments(path: str, d: StorageDescriptor, total: int) -> list[tuple[int, int, str, int]]:
    """First position, number of values, file, and byte of the first value, of what the stream lies in."""
    if not os.path.isdir(path):
        return [(0, total, path, d.offset)]
    firsts = sorted(int(x) for x in os.listdir(path) if x.isdigit())
    ends = [*firsts[1:], total]
    for a, b in zip(firsts, ends, strict=True):
        if d.type != "bit" and os.path.getsize(f"{path}/{a}") < (b - a) * d.dtype.itemsize:
            raise EOFError("the stream ends before the data")
    return [(a, b - a, f"{path}/{a}", 0) for a, b in zip(firsts, ends, strict=True)]


def read_image(spark: SparkSession, path: str, d: StorageDescriptor, dims, spatial: int | None = None, geometry: Geometry | None = None, form: str = "auto", volumes: list[int] | None = None, mask: Image | None = None) -> Image:
    """The image in a stream. form: auto (sparse with a mask, packed where the type allows it, else dense), dense, sparse, packed.

    ``volumes`` (1-based, any order, repeats read once) picks along the last
    axis; the stream must be ordered by it.
    """
    view_dims, layout = _stream_layout(d, tuple(int(x) for x in dims))
    spatial = min(3, len(dims)) if spatial is None else spatial
    scaled = (d.slope or 1.0) != 1.0 or (d.intercept or 0.0) != 0.0
    form = ("sparse" if mask is not None else "packed" if d.type in PACKED else "dense") if form == "auto" else form
    if form == "packed" and d.type not in PACKED:
        raise ValueError(f"{d.type} can't be packed")
    store_dims = L.storage_dims(view_dims, layout)
    picked = None
    if volumes is not None:
        if len(view_dims) <= spatial or layout[-1] != len(view_dims):
            raise ValueError("volumes need a last value axis that is last in the stream too")
        if any(not 1 <= v <= view_dims[-1] for v in volumes):
            raise IndexError("a volume is out of range")
        picked = [int(v) - 1 for v in volumes]
    size, bits = d.dtype.itemsize, d.type == "bit"
    block = prod(store_dims[:-1]) if picked is not None else prod(store_dims)
    starts = [k * block for k in sorted(set(picked))] if picked is not None else [0]
    remote = _is_remote(path)
    segments = _remote_segments(spark, path, d, prod(store_dims)) if remote else _segments(path, d, prod(store_dims))
    packed_file = path.endswith(".gz") if remote else not os.path.isdir(path) and not is_seekable(path)
    chain = members(path) if packed_file and not remote else None
    whole = packed_file and chain is None
    # A task a run of values, or a member; other gzip is read forward by one task.
    if whole:
        runs = [(starts[0] if starts else 0, 0, segments[0][2], d.offset, 0)]
    elif packed_file:
        held = [(a, at) for a, at in chain if a >= 0]
        if -sum(a for a, _ in chain if a < 0) != d.offset or not held or held[0][0]:
            raise ValueError("the offset is not the one that the stream was written with")
        ends = [*(a for a, _ in held[1:]), prod(store_dims)]
        runs = [(max(s, a), min(s + block, end) - max(s, a), path, at, max(s, a) - a) for s in starts for (a, at), end in zip(held, ends, strict=True) if max(s, a) < min(s + block, end)]
    else:
        runs = [(a, min(RUN, end - a), file, base + ((a - first) // 8 if bits else (a - first) * size), (a - first) % 8) for s in starts for first, n, file, base in segments for end in [min(s + block, first + n)] for a in range(max(s, first), end, RUN)]
    keep = spark.sparkContext.broadcast(mask_bits(mask, prod(view_dims[:spatial]))) if mask is not None and form == "sparse" and prod(view_dims[:spatial]) <= MOST_MASK else None
    wanted = sorted(starts)
    value = "struct<re:double,im:double>" if d.type.startswith("complex") else "boolean" if bits else PACKED[d.type][0] if form == "packed" else "double" if scaled or d.type in ("uint32", "int64", "float32", "float64") else "int"

    def locations(p: np.ndarray) -> np.ndarray:
        """View locations of some stream positions."""
        loc, step = np.zeros(len(p), np.int64), 1
        for k in range(spatial):
            axis = abs(layout[k]) - 1
            own = p // prod(store_dims[:axis]) % store_dims[axis]
            loc += (own if layout[k] > 0 else view_dims[k] - 1 - own) * step
            step *= view_dims[k]
        return loc

    def wanted_only(part: pa.RecordBatch) -> pa.RecordBatch:
        if keep is None:
            return part
        loc = locations(part.column("p").to_numpy())
        return part.filter(pa.array((keep.value[loc >> 3] >> (7 - (loc & 7)).astype(np.uint8)) & 1 == 1))

    def cells(at: int, raw: bytes) -> pa.RecordBatch:
        x, im, gone = _decode(raw, d, form == "packed")
        if im is not None:
            v = pa.StructArray.from_arrays([pa.array(x), pa.array(im)], ["re", "im"], mask=pa.array(gone))
        elif form == "packed":
            v = pa.array(x.astype(x.dtype.newbyteorder("=")).astype({"tinyint": "i1", "smallint": "i2", "int": "i4", "float": "f4"}[value]))
        elif value == "int":
            v = pa.array(x.astype(np.int32))
        else:
            y = x.astype(float)
            v = pa.array(y * (d.slope or 1.0) + (d.intercept or 0.0) if scaled else y, mask=gone)
        return wanted_only(pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(x), dtype=np.int64)), v], ["p", "v"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content").to_pylist() if remote else itertools.repeat(None)
            for at, n, file, base, bit, content in zip(*(batch.column(c).to_pylist() for c in ("at", "n", "file", "base", "bit")), contents, strict=False):
                with MemberStream(file, base) if chain else open_bytes(content) if remote else open_stream(file) as stream:
                    if chain:  # ``bit``: values of the member before the first wanted one
                        skip(stream, bit // 8 if bits else bit * size)
                        bit = bit % 8
                    else:
                        skip(stream, base)
                    if bits:  # volumes may start inside a byte
                        here = 0  # bytes of the stream behind us
                        for s, m, first in [(s, block, s) for s in wanted] if whole else [(at, n, bit)]:
                            if whole and first // 8 < here:  # the byte that the last volume ended in
                                left, first = last, first % 8
                            else:
                                skip(stream, first // 8 - here)
                                left, here, first = b"", first // 8, first % 8
                            need = -(-(first + m) // 8) - len(left)
                            here += need
                            for raw in itertools.chain([left] if left and not need else [], chunks(stream, need, 1 << 18)):
                                raw, left = (left + raw if raw is not left else raw), b""
                                last = raw[-1:]
                                x = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little" if d.bit_order == "lsb" else "big")[first : first + m].astype(bool)
                                yield wanted_only(pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + len(x), dtype=np.int64)), pa.array(x)], ["p", "v"]))
                                s, m, first = s + len(x), m - len(x), 0
                        continue
                    here = 0 if whole else at
                    for s, m in [(s, block) for s in wanted] if whole else [(at, n)]:
                        skip(stream, (s - here) * size)
                        for raw in chunks(stream, m * size, 4 << 20, size):
                            yield cells(s, raw)
                            s += len(raw) // size
                        here = s

    frame = spark.createDataFrame(runs, "at long, n long, file string, base long, bit int").repartition(max(1, min(len(runs), 10_000)))
    if remote:  # the readers of Spark open the files that a run lies in
        files = spark.read.format("binaryFile").load(sorted({r[2] for r in runs}) or path).select(F.col("path").alias("file"), "content")
        frame = files.join(F.broadcast(frame), "file")
    raw = frame.mapInArrow(run, f"p long, v {value}")
    axes = [L.axis_of(F.col("p"), store_dims, k) for k in range(len(store_dims))]
    view = [axes[abs(s) - 1] if s > 0 else F.lit(n - 1) - axes[abs(s) - 1] for s, n in zip(layout, view_dims, strict=True)]
    out_dims = view_dims
    if picked is not None:
        out_dims = (*view_dims[:-1], len(picked))
        slots = F.create_map(*[x for v in sorted(set(picked)) for x in (F.lit(v), F.array(*(F.lit(k) for k, p in enumerate(picked) if p == v)))])
        raw = raw.withColumn("slot", F.explode(slots[view[-1].cast("int")]))
        view[-1] = F.col("slot").cast("long")
    loc, elem = L.flatten(view[:spatial], out_dims[:spatial]), L.flatten(view[spatial:], out_dims[spatial:]).cast("int")
    made = raw.select(loc.alias("loc"), elem.alias("elem"), "v")
    kind = "complex" if im_type(d) else "logical" if bits else "double" if value == "double" else "integer"
    base = from_cells(made, out_dims, spatial, "dense", kind if form != "packed" else "double", geometry)
    if form == "packed":
        return replace(base, kind="packed", stored=d.type, slope=d.slope or 1.0, intercept=d.intercept or 0.0)
    if form == "sparse":
        if mask is not None:  # exactly the mask's locations, zeros and all
            return replace(base, kind="sparse", cells=made if keep is not None else made.join(mask_locations(mask, base.n_locations), "loc", "left_semi"))
        return tighten(replace(base, kind="sparse"))
    return base


def im_type(d: StorageDescriptor) -> bool:
    return d.type.startswith("complex")


def write_image(image: Image, path: str, d: StorageDescriptor, widen: bool = False) -> StorageDescriptor:
    """Write an image as a stream; returns the descriptor that reads it (with the scaling used; ``widen``: and the wider
    integer type, where the one asked for does not reach the values with their scaling, or whole values without one). A path that ends in .gz is compressed, one that ends in .parts stays in parts."""
    channels = CHANNELS.get(d.type)
    dims = image.dims[:-1] if channels else image.dims
    if channels and image.dims[-1] != channels:
        raise ValueError(f"{d.type} needs a last axis of {channels} channels")
    _, layout = _stream_layout(d, dims)
    same = image.is_packed and image.stored == d.type and d.slope in (None, image.slope) and d.intercept in (None, image.intercept)
    if same:  # already in the stream's form: stored values as they are
        source = replace(image, kind="dense", stored=None, slope=1.0, intercept=0.0)
        slope, intercept, rows = image.slope, image.intercept, source.view()
    else:
        rows = image.as_dense().view()
        slope, intercept = d.slope, d.intercept
        if image.value_type == "complex" and not im_type(d):
            raise ValueError(f"complex values can't be written as {d.type}")
        whole = np.dtype(TYPES[d.type]).kind in "iu"
        if whole and not channels and d.type != "bit":
            low, high = np.iinfo(TYPES[d.type]).min, np.iinfo(TYPES[d.type]).max
            v = F.col("v").cast("double")
            bad = missing(v) | (F.abs(v) == float("inf"))
            row = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(bad).alias("bad"), F.bool_and(v == F.floor(v).cast("double")).alias("whole")).first()
            if row["bad"]:
                raise ValueError("integers can't hold missing or infinite values")
            if widen and (row["whole"] or slope is not None or intercept is not None):
                d = replace(d, type=wide_enough(d.type, row["lo"], row["hi"], slope or 1.0, intercept or 0.0, WIDER))
                low, high = np.iinfo(TYPES[d.type]).min, np.iinfo(TYPES[d.type]).max
            if slope is None and intercept is None:
                fits = row["lo"] is None or row["whole"] and row["lo"] >= low and row["hi"] <= high
                slope, intercept = (1.0, 0.0) if fits else calibrate(d.type, row["lo"], row["hi"], row["whole"]) if d.type in PACKED else (None, None)
                if slope is None:
                    raise ValueError(f"the values don't fit {d.type}")
            slope, intercept = slope or 1.0, intercept or 0.0
            ends = [round((x - intercept) / slope) for x in (row["lo"], row["hi"]) if x is not None]
            if any(not low <= e <= high for e in ends):
                raise ValueError(f"the values are out of range of {d.type} with this scaling")
        slope, intercept = slope or 1.0, intercept or 0.0
    store_dims = L.storage_dims(image.dims, layout)
    n = image.n_locations
    number = F.col("loc") + F.col("elem").cast("long") * n
    view = [L.axis_of(number, image.dims, k) for k in range(len(image.dims))]
    own = [None] * len(view)
    for k, s in enumerate(layout):
        own[abs(s) - 1] = view[k] if s > 0 else F.lit(image.dims[k] - 1) - view[k]
    ranged = rows.select(L.flatten(own, store_dims).alias("p"), "v")
    if d.type == "bit":  # partitions begin where a byte does
        ranged = ranged.withColumn("block", F.call_function("div", F.col("p"), F.lit(MASK_BLOCK))).repartitionByRange("block").drop("block")
    else:
        ranged = ranged.repartitionByRange("p")
    in_parts, gz, total, bit = path.endswith(".parts"), path.endswith(".gz"), prod(image.dims), d.type == "bit"
    code, complex_out = d.dtype, im_type(d)
    target = path if in_parts else f"{path}.writing-{uuid.uuid4().hex}"
    folder = target if in_parts or gz else None
    if in_parts:
        shutil.rmtree(path, ignore_errors=True)
    if folder:
        os.makedirs(folder)
    else:
        _preallocate(target, d.offset + (-(-total // 8) if bit else total * code.itemsize))

    def encoded(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column("v")
        if complex_out and pa.types.is_struct(v.type):
            gone = v.is_null().to_numpy(zero_copy_only=False)
            x = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False)
            x[gone] = complex(np.nan, np.nan)
        else:
            x = v.cast(pa.float64()).to_numpy(zero_copy_only=False) if not pa.types.is_boolean(v.type) else np.array([np.nan if y is None else float(y) for y in v.to_pylist()])
        if bit:
            return x != 0
        x = x if same or slope == 1 and intercept == 0 else (x - intercept) / slope
        return (np.rint(x) if code.kind in "iu" else x).astype(code)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        """First position, number of values and bytes of runs of positions; bits are cut where a byte ends."""
        held, first, step = [], None, MASK_BLOCK if gz else 1 << 16
        for batch in batches:
            if not batch.num_rows:
                continue
            p, x = batch.column("p").to_numpy(), encoded(batch)
            if not np.array_equal(p, np.arange(p[0], p[0] + len(p))) or held and p[0] != first + sum(map(len, held)):
                raise ValueError("the image lacks cells, or has some twice")
            first = p[0] if first is None else first
            held.append(x)
            if sum(map(len, held)) >= step:
                x = np.concatenate(held)
                for k in range(0, len(x) - step + 1, step):
                    yield int(first) + k, step, packed(x[k : k + step])
                cut = len(x) // step * step
                held, first = ([x[cut:]], first + cut) if cut < len(x) else ([], None)
        if held:
            x = np.concatenate(held)
            yield int(first), len(x), packed(x)

    def packed(x: np.ndarray) -> bytes:
        return np.packbits(x, bitorder="little" if d.bit_order == "lsb" else "big").tobytes() if bit else x.astype(code).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, count, size, out, name = None, 0, 0, None, None
        for first, n, raw in pieces(batches):
            if out is None:
                start = first
                name = f"{folder}/.{first}-{os.getpid()}"
                out = open(name, "wb") if folder else open(target, "r+b")  # noqa: SIM115
            if not folder:
                out.seek(d.offset + (first // 8 if bit else first * code.itemsize))
            raw = member(raw, first) if gz else raw
            out.write(raw)
            count, size = count + n, size + len(raw)
        if out is not None:
            out.close()
            if folder:
                os.replace(name, f"{folder}/{start}")  # a task that runs twice leaves one file
            yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["first", "n", "size"])

    spark = image.cells.sparkSession
    try:
        done = sorted(map(tuple, ranged.sortWithinPartitions("p").mapInArrow(run, "first long, n long, size long").collect()))  # a row a partition
        if sum(n for _, n, _ in done) != total:
            raise ValueError("the image lacks cells")
        if gz:
            _put_together(spark, folder, [(f, size) for f, _, size in done], f"{target}.file", member(bytes(d.offset), -d.offset) if d.offset else b"")
        if not in_parts:
            os.replace(f"{target}.file" if gz else target, path)
    finally:
        if gz:
            shutil.rmtree(folder, ignore_errors=True)
        for left in (target, f"{target}.file"):
            if not in_parts and os.path.isfile(left):
                os.remove(left)
    return replace(d, slope=slope, intercept=intercept)


def _preallocate(path: str, size: int) -> None:
    """A file of zeros that tasks write into."""
    with open(path, "wb") as f:
        f.truncate(size)


def _put_together(spark: SparkSession, folder: str, parts: list[tuple[int, int]], path: str, head: bytes) -> None:
    """One file of a head and parts (first, size), each copied to its place by a task."""
    _preallocate(path, len(head) + sum(size for _, size in parts))
    with open(path, "r+b") as f:
        f.write(head)
    places, at = [], len(head)
    for first, size in parts:
        places.append((f"{folder}/{first}", at))
        at += size

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist(), strict=True):
                with open(name, "rb") as part, open(path, "r+b") as f:
                    f.seek(at)
                    shutil.copyfileobj(part, f, 4 << 20)
            yield batch.select(["at"])

    rows = spark.createDataFrame(places, "name string, at long").repartition(max(1, min(len(places), 1000)))
    if rows.mapInArrow(copy, "at long").count() != len(places):
        raise OSError(f"{path}: not all parts were copied")
